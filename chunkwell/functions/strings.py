"""Fixed and variable-length strings."""

from __future__ import annotations

import struct

from ..errors import CorruptError, UnsupportedError
from ..fmt import heaps
from ..fmt.cursor import UNDEFINED

REFERENCE = struct.Struct("<IQI")


def fixed_strings(raw: bytes, width: int) -> list[str]:
    """Trims NULs and spaces from the right whatever the padding; no width, no strings."""
    if width <= 0:
        return []
    return [raw[i : i + width].rstrip(b"\0 ").decode("utf-8", "replace") for i in range(0, len(raw) - width + 1, width)]


def padded_strings(raw: bytes, width: int, padding: int) -> list[str]:
    """As attributes trim: up to the first NUL, trailing NULs, or trailing spaces."""
    if width <= 0:
        return []
    parts = [raw[i : i + width] for i in range(0, len(raw) - width + 1, width)]
    if padding == 0:
        parts = [p.split(b"\0", 1)[0] for p in parts]
    elif padding == 1:
        parts = [p.rstrip(b"\0") for p in parts]
    elif padding == 2:
        parts = [p.rstrip(b" ") for p in parts]
    else:
        raise UnsupportedError(f"string padding {padding}")
    return [p.decode("utf-8", "replace") for p in parts]


def references(raw: bytes) -> list[tuple[int, int, int]]:
    """(length, collection address, object index) of 16-byte references; the index has 16 bits."""
    return [(n, a, i & 0xFFFF) for n, a, i in REFERENCE.iter_unpack(raw[: len(raw) // 16 * 16])]


def vl_strings(source, raw: bytes, cache: dict | None = None) -> list[str]:
    """Strings behind references.  Empty ones have no length or no address; each collection is read once."""
    cache = {} if cache is None else cache
    out = []
    for n, address, index in references(raw):
        if n == 0 or address in (0, UNDEFINED):
            out.append("")
            continue
        if address not in cache:
            cache[address] = heaps.collection(source, address)
        found = cache[address].get(index)
        if found is None:
            raise CorruptError(f"no object {index} in the heap collection at {address}")
        out.append(found[:n].decode("utf-8", "replace"))
    return out
