"""B-trees of both versions, enumerated level by level with one batch of reads per level."""

from __future__ import annotations

from collections.abc import Iterator

from ..errors import CorruptError, ParseError, UnsupportedError
from .cursor import UNDEFINED, Cursor, bytes_for

MAX_LEVELS = 64


def v1_leaves(source, root: int, kind: int, rank: int = 0) -> Iterator[tuple[tuple, int]]:
    """(key, address of the child) of each leaf entry; kind 0: groups (key: heap offset), 1: chunks (key: size, mask, offsets)."""
    key_size = 8 if kind == 0 else 8 + 8 * (rank + 1)
    level = [root] if root != UNDEFINED else []
    seen: set[int] = set()
    for _ in range(MAX_LEVELS):
        if not level:
            return
        if seen & set(level):
            raise CorruptError("a tree node is its own descendant")
        seen |= set(level)
        # heads tell how long the nodes are
        heads = source.metadata_many([(a, 24) for a in level])
        counts = []
        for h in heads:
            c = Cursor(h)
            c.expect(b"TREE")
            if c.u8() != kind:
                raise ParseError("tree node of another type")
            counts.append((c.u8(), c.u16()))
        bodies = source.metadata_many([(a + 24, n * (key_size + 8) + key_size) for a, (_, n) in zip(level, counts, strict=True)])
        below: list[int] = []
        for (depth, n), body in zip(counts, bodies, strict=True):
            c = Cursor(body)
            for _ in range(n):
                key = (c.u64(),) if kind == 0 else (c.u32(), c.u32(), tuple(c.u64() for _ in range(rank + 1))[:rank])
                child = c.u64()
                if depth == 0:
                    yield key, child
                else:
                    below.append(child)
        level = below
    raise CorruptError("tree is too deep")


def v2_records(source, address: int, kind: int | tuple[int, ...]) -> Iterator[bytes]:
    """All records of a version 2 tree, in no promised order."""
    if address == UNDEFINED:
        return
    c = Cursor(source.metadata(address, 38))
    c.expect(b"BTHD")
    if c.u8():
        raise UnsupportedError("version of a v2 tree")
    found = c.u8()
    if found not in (kind if isinstance(kind, tuple) else (kind,)):
        raise UnsupportedError(f"v2 tree of type {found}")
    node, size, depth = c.u32(), c.u16(), c.u16()
    c.skip(2)
    root, count = c.u64(), c.u16()
    if root == UNDEFINED or not size:
        return
    if depth > MAX_LEVELS or node < 16:
        raise ParseError("v2 tree header")
    # most records of a node of each depth, and of all below it, decide the widths of child pointers
    most = [(node - 10) // size]
    below = [most[0]]
    width = bytes_for(most[0])
    totals = [0]
    for d in range(1, depth + 1):
        pointer = 8 + width + (bytes_for(below[d - 1]) if d > 1 else 0)
        totals.append(bytes_for(below[d - 1]) if d > 1 else 0)
        most.append(max(0, (node - 10 - pointer) // (size + pointer)))
        below.append((most[d] + 1) * below[d - 1] + most[d])
    level = [(root, count)]
    for d in range(depth, -1, -1):
        lower: list[tuple[int, int]] = []
        pointer = 8 + width + totals[d]
        spans = [(a, 6 + n * size + (d > 0) * (n + 1) * pointer) for a, n in level]
        for (_, n), data in zip(level, source.metadata_many(spans), strict=True):
            c = Cursor(data)
            c.expect(b"BTIN" if d else b"BTLF")
            c.skip(2)
            for _ in range(n):
                yield c.take(size)
            for _ in range((n + 1) * (d > 0)):
                lower.append((c.u64(), c.uint(width)))
                c.skip(totals[d])
        level = lower
