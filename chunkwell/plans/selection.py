"""Hyperslabs: one half-open range for each dimension."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

from ..errors import InvalidSelectionError

Box = tuple[tuple[int, int], ...]


def parse(text: str) -> list[tuple[int, int | None]]:
    """`a:b,c:d`; either end may be left out; an empty text selects a scalar."""
    out: list[tuple[int, int | None]] = []
    for part in [p.strip() for p in text.split(",")] if text.strip() else []:
        a, colon, b = part.partition(":")
        try:
            out.append((int(a or 0), int(b) if b.strip() else None) if colon else (int(part), int(part) + 1))
        except ValueError:
            raise InvalidSelectionError(f"range {part!r}") from None
    return out


def clamp(ranges, shape: tuple[int, ...]) -> Box:
    """Ranges cut to the extent; outside of it they are empty.  Their number must be the rank, and none may run backwards."""
    ranges = [(0, n) for n in shape] if ranges is None else list(ranges)
    if len(ranges) != len(shape):
        raise InvalidSelectionError(f"{len(ranges)} ranges for rank {len(shape)}")
    out = []
    for (a, b), n in zip(ranges, shape, strict=True):
        b = n if b is None else b
        if a < 0 or b < a:
            raise InvalidSelectionError(f"range {a}:{b}")
        out.append((min(a, n), min(b, n)))
    return tuple(out)


def is_empty(box: Box) -> bool:
    return any(a >= b for a, b in box)


def intersect(x: Box, y: Box) -> Box | None:
    out = tuple((max(a, c), min(b, d)) for (a, b), (c, d) in zip(x, y, strict=True))
    return None if is_empty(out) else out


def volume(box: Box) -> int:
    n = 1
    for a, b in box:
        n *= max(0, b - a)
    return n


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Row-major, in elements."""
    out, n = [], 1
    for d in reversed(shape):
        out.append(n)
        n *= d
    return tuple(reversed(out))


def cells(box: Box, chunk: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """Element offsets of the chunks that a box touches, in row-major order."""
    yield from product(*(range(a // c * c, b, c) for (a, b), c in zip(box, chunk, strict=True)))


_WORD = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\w+|\S")
_COMPARED = re.compile(r"i(\d+) (<=|>=|<|>|=|==) (\d+)")
_LISTED = re.compile(r"i(\d+) in \( (\d+(?: , \d+)*) \)")


def bounds(condition: str) -> dict[int, tuple[int, int]]:
    """By dimension, the half-open range that the conjuncts of a SQL condition leave of an index column.

    Only plain comparisons and IN lists at the top level count; anything else leaves the range as it is.
    """
    words = [w.lower() for w in _WORD.findall(condition)]
    parts: list[list[str]] = [[]]
    depth = 0
    for w in words:
        depth += (w == "(") - (w == ")")
        if depth == 0 and w == "and":
            parts.append([])
        else:
            parts[-1].append(w)
        if depth == 0 and w in ("or", "between", "case", "not"):
            return {}
    out: dict[int, tuple[int, int]] = {}
    for p in parts:
        text = " ".join(p).replace("< =", "<=").replace("> =", ">=").replace("= =", "=")
        if m := _COMPARED.fullmatch(text):
            v = int(m[3])
            a, z = {"<": (0, v), "<=": (0, v + 1), ">": (v + 1, 1 << 63), ">=": (v, 1 << 63)}.get(m[2], (v, v + 1))
        elif m := _LISTED.fullmatch(text):
            values = [int(x) for x in m[2].split(" , ")]
            a, z = min(values), max(values) + 1
        else:
            continue
        b, y = out.get(int(m[1]), (0, 1 << 63))
        out[int(m[1])] = (max(a, b), max(max(a, b), min(z, y)))
    return out
