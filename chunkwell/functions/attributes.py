"""Decoded attribute values and their accessors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fmt import messages
from ..fmt.messages import Attribute
from .strings import padded_strings, vl_strings

KIND = "struct<kind:string,str:string,strs:array<string>,ints:array<bigint>,floats:array<double>,raw:binary>"


@dataclass(frozen=True)
class Value:
    """One of five kinds: str, strs, ints, floats, raw."""

    kind: str
    value: object

    def as_str(self) -> str | None:
        """A string, also one that is the only element of a vector."""
        if self.kind == "str":
            return self.value
        return self.value[0] if self.kind == "strs" and len(self.value) == 1 else None

    def as_strs(self) -> list[str] | None:
        return self.value if self.kind == "strs" else [self.value] if self.kind == "str" else None

    def as_ints(self) -> list[int] | None:
        return self.value if self.kind == "ints" else None

    def as_floats(self) -> list[float] | None:
        return self.value if self.kind == "floats" else None

    def row(self) -> dict:
        return dict.fromkeys(("str", "strs", "ints", "floats", "raw")) | {"kind": self.kind, self.kind: self.value}


def ints_from(raw: bytes, size: int, signed: bool, big: bool = False) -> list[int]:
    """Integers of 1 to 8 bytes as 64-bit ones; the top half of u64 wraps to negative numbers."""
    if size not in range(1, 9):
        return []
    order = "big" if big else "little"
    out = [int.from_bytes(raw[i : i + size], order, signed=signed) for i in range(0, len(raw) - size + 1, size)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def floats_from(raw: bytes, size: int, big: bool = False) -> list[float]:
    """4 and 8 byte floats as doubles; of any other width each is NaN."""
    if size in (4, 8):
        return np.frombuffer(raw, f"{'>' if big else '<'}f{size}", len(raw) // size).astype(float).tolist()
    return [float("nan")] * (len(raw) // size if size else 0)


def decode(source, a: Attribute) -> Value:
    t, scalar = a.dtype, a.space.kind == "scalar"
    if t.cls == messages.STRING:
        found = padded_strings(a.data, t.size, t.padding)
    elif t.cls == messages.VARIABLE:
        found = vl_strings(source, a.data)
    elif t.cls == messages.FIXED:
        return Value("ints", ints_from(a.data, t.size, t.signed, t.big_endian))
    elif t.cls == messages.ENUM:
        return Value("ints", ints_from(a.data, t.size, False, t.big_endian))
    elif t.cls == messages.FLOAT:
        return Value("floats", floats_from(a.data, t.size, t.big_endian))
    else:
        return Value("raw", a.data)
    return Value("str", found[0]) if scalar and found else Value("strs", found)


# the same accessors on rows of mode=attributes


def as_str(a: str = "") -> Column:
    c = lambda x: F.col(f"{a}.{x}" if a else x)
    return F.when(c("kind") == "str", c("str")).when((c("kind") == "strs") & (F.size(c("strs")) == 1), F.element_at(c("strs"), 1))


def as_strs(a: str = "") -> Column:
    c = lambda x: F.col(f"{a}.{x}" if a else x)
    return F.when(c("kind") == "strs", c("strs")).when(c("kind") == "str", F.array(c("str")))
