"""Chunk indexes: from a layout to the table of stored chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

from ..errors import CorruptError, ParseError
from . import trees
from .cursor import UNDEFINED, Cursor
from .messages import Dataspace, Layout

UNLIMITED = (1 << 64) - 1
READ_BYTES = 1 << 20  # of an index at once


@dataclass(frozen=True)
class Chunk:
    offsets: tuple[int, ...]  # in elements
    address: int
    size: int
    mask: int = 0  # bit k set: filter k was left out


@dataclass(frozen=True)
class Table:
    """Chunks as columns: offsets (a row each), addresses, sizes and masks; an index may have millions."""

    at: np.ndarray
    address: np.ndarray
    size: np.ndarray
    mask: np.ndarray

    def __len__(self) -> int:
        return len(self.address)

    @classmethod
    def of(cls, found: list[Chunk], rank: int) -> Table:
        return cls(np.array([c.offsets for c in found], "i8").reshape(len(found), rank), *(np.array([getattr(c, k) for c in found], "u8") for k in ("address", "size", "mask")))

    def take(self, which: np.ndarray | slice) -> Table:
        return Table(self.at[which], self.address[which], self.size[which], self.mask[which])

    def list(self) -> list[Chunk]:
        return [Chunk(tuple(o), a, n, m) for o, a, n, m in zip(self.at.tolist(), self.address.tolist(), self.size.tolist(), self.mask.tolist(), strict=True)]


def table(source, space: Dataspace, layout: Layout, filtered: bool) -> Table:
    """Stored chunks inside the extent."""
    rank = len(layout.chunk)
    if layout.address == UNDEFINED:
        return Table.of([], rank)
    raw = math.prod(layout.chunk) * layout.size
    if layout.index == "BTreeV1":
        parts = _listed((Chunk(key[2], address, key[0], key[1]) for key, address in trees.v1_leaves(source, layout.address, 1, rank)), space)
    elif layout.index == "SingleChunk":
        size, mask = layout.index_params or (raw, 0)
        parts = _listed(iter([Chunk((0,) * rank, layout.address, size, mask)]), space)
    elif layout.index == "Implicit":
        grid = grid_of(space, layout, True)
        steps = range(0, math.prod(grid), READ_BYTES)
        numbers = (np.arange(i, min(i + READ_BYTES, steps.stop), dtype="u8") for i in steps)
        parts = _placed(((i, np.uint64(layout.address) + i * np.uint64(raw), *_plain(len(i), raw)) for i in numbers), grid, layout.chunk, None, space)
    elif layout.index == "FixedArray":
        parts = _placed(_fixed_array(source, layout.address, raw, filtered), grid_of(space, layout, True), layout.chunk, None, space)
    elif layout.index == "ExtensibleArray":
        parts = _placed(_extensible_array(source, layout.address, raw, filtered), grid_of(space, layout, True), layout.chunk, _unlimited(space), space)
    else:
        parts = _listed(_tree2(source, layout, raw, filtered), space)
    found = list(parts)
    if not found:
        return Table.of([], rank)
    at, address = (np.concatenate([getattr(t, k) for t in found]) for k in ("at", "address"))
    if filtered or layout.index == "SingleChunk":
        size, mask = (np.concatenate([getattr(t, k) for t in found]) for k in ("size", "mask"))
    else:
        size, mask = _plain(len(address), raw)
        if layout.index == "BTreeV1":  # its keys have the sizes
            size, mask = (np.concatenate([getattr(t, k) for t in found]) for k in ("size", "mask"))
    if layout.plain_edges:  # partial edge chunks skip all filters
        mask = np.where((at + np.array(layout.chunk) > np.array(space.dims)).any(axis=1), 0xFFFFFFFF, mask)
    return Table(at, address, size, mask)


def chunks(source, space: Dataspace, layout: Layout, filtered: bool) -> list[Chunk]:
    return table(source, space, layout, filtered).list()


def _plain(n: int, raw: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and masks of chunks without filters."""
    return np.broadcast_to(np.uint64(raw), n), np.broadcast_to(np.uint64(0), n)


def _listed(found: Iterator[Chunk], space: Dataspace) -> Iterator[Table]:
    inside = (c for c in found if all(o < d for o, d in zip(c.offsets, space.dims, strict=True)))
    while part := list(islice(inside, 1 << 16)):
        yield Table.of(part, len(space.dims))


def grid_of(space: Dataspace, layout: Layout, limits: bool = False) -> tuple[int, ...]:
    """Chunks in each dimension; with limits, of the largest extent where that is finite, as linear indexes count them."""
    dims = space.dims
    if limits and space.max_dims:
        dims = tuple(d if m == UNLIMITED else m for d, m in zip(space.dims, space.max_dims, strict=True))
    return tuple(-(-d // c) for d, c in zip(dims, layout.chunk, strict=True))


def _unlimited(space: Dataspace) -> int | None:
    return next((i for i, m in enumerate(space.max_dims or ()) if m == UNLIMITED), None)


def _placed(entries: Iterator[tuple[np.ndarray, ...]], grid: tuple[int, ...], chunk: tuple[int, ...], grows: int | None, space: Dataspace) -> Iterator[Table]:
    """Entries (numbers, addresses, sizes, masks) with their offsets.  An unlimited dimension counts slowest."""
    order = list(range(len(grid)))
    if grows:
        order = [grows, *order[:grows], *order[grows + 1 :]]
    for numbers, address, size, mask in entries:
        keep = (address != 0) & (address != np.uint64(UNDEFINED))
        rest = numbers.astype("u8")
        at = np.empty((len(rest), len(grid)), "u8")
        for d in reversed(order[1:]):
            at[:, d] = rest % np.uint64(max(1, grid[d]))
            rest = rest // np.uint64(max(1, grid[d]))
        at[:, order[0]] = rest
        for d, (n, c) in enumerate(zip(space.dims, chunk, strict=True)):
            keep &= at[:, d] < np.uint64(-(-n // c))
        at *= np.array(chunk, "u8")
        yield Table(at.astype("i8"), address, size, mask).take(slice(None) if keep.all() else keep)


def _entries(data: bytes, first: int, rows: int, page: int, tail: int, width: int, raw: int, filtered: bool) -> tuple[np.ndarray, ...]:
    """Numbers, addresses, sizes and masks of the entries of so many pages, each followed by tail bytes."""
    if len(data) < rows * (page * width + tail) - tail:
        raise ParseError(f"array entries of {len(data)} bytes")
    cells = np.zeros((rows, page * width + tail), "u1")
    cells.reshape(-1)[: len(data)] = np.frombuffer(data, "u1", min(len(data), cells.size))
    numbers = np.arange(first, first + rows * page, dtype="u8")
    cells = cells[:, : page * width].reshape(rows * page, width)
    address = np.ascontiguousarray(cells[:, :8]).view("<u8").reshape(-1)
    if not filtered:
        return numbers, address, *_plain(len(address), raw)
    size = np.zeros((len(cells), 8), "u1")
    size[:, : width - 12] = cells[:, 8 : width - 4]
    return numbers, address, size.view("<u8").reshape(-1), np.ascontiguousarray(cells[:, width - 4 :]).view("<u4").reshape(-1).astype("u8")


def _pages(source, at: int, first: int, n: int, page: int, there: bytes | None, width: int, raw: int, filtered: bool):
    """Entries of the pages of n elements that the bitmap has, the first at an address; whole pages that follow each other are read together."""
    step = page * width + 4
    has = lambda p: there is None or there[p // 8] & 0x80 >> p % 8
    most, whole, p = max(1, READ_BYTES // step), n // page, 0
    while p < whole:
        z = p
        while z < whole and z - p < most and has(z):
            z += 1
        if z > p:
            yield _entries(source.metadata(at + p * step, (z - p) * step - 4), first + p * page, z - p, page, 4, width, raw, filtered)
        p = max(z, p + 1)
    if n % page and has(whole):
        yield _entries(source.metadata(at + whole * step, n % page * width), first + whole * page, 1, n % page, 0, width, raw, filtered)


def _fixed_array(source, address: int, raw: int, filtered: bool):
    c = Cursor(source.metadata(address, 28))
    c.expect(b"FAHD")
    c.skip(2)
    width, bits, n, block = c.u8(), c.u8(), c.u64(), c.u64()
    _width(width, filtered)
    if block == UNDEFINED:
        return
    if n * width > source.size * 8:
        raise CorruptError("fixed array is larger than the file")
    page = 1 << bits
    Cursor(source.metadata(block, 4)).expect(b"FADB")
    at = block + 14
    if n <= page:
        yield _entries(source.metadata(at, n * width), 0, 1, n, 0, width, raw, filtered)
        return
    there = source.metadata(at, -(-(-(-n // page)) // 8))
    yield from _pages(source, at + len(there) + 4, 0, n, page, there, width, raw, filtered)


def _width(width: int, filtered: bool) -> None:
    if width != 8 and not filtered or filtered and not 13 <= width <= 20:
        raise ParseError(f"array entries of {width} bytes")


def _extensible_array(source, address: int, raw: int, filtered: bool):
    c = Cursor(source.metadata(address, 72))
    c.expect(b"EAHD")
    c.skip(2)
    width, bits, inline, least, pointers, page_bits = (c.u8() for _ in range(6))
    _width(width, filtered)
    c.skip(4 * 8)  # numbers and sizes of blocks
    stored = c.u64()  # highest index in use and one
    c.skip(8)
    block = c.u64()
    if block == UNDEFINED:
        return
    if not least or not pointers or bits > 64:
        raise ParseError("extensible array header")
    offset_size = (bits + 7) // 8
    blocks = 1 + bits - (least.bit_length() - 1)  # super blocks of the whole array
    shape = [(1 << u // 2, (1 << (u + 1) // 2) * least) for u in range(blocks)]  # data blocks, and elements of each
    direct = 2 * (pointers.bit_length() - 1)  # super blocks whose data blocks the index block points to
    n_direct = sum(n for n, _ in shape[:direct])
    c = Cursor(source.metadata(block, 14 + inline * width + 8 * (n_direct + max(0, blocks - direct))))
    c.expect(b"EAIB")
    c.skip(10)
    if inline:
        yield _entries(c.take(inline * width), 0, 1, inline, 0, width, raw, filtered)
    at = inline
    for n, elements in shape[:direct]:
        for _ in range(n):
            data = c.u64()
            if data != UNDEFINED and at < stored:
                yield from _data_block(source, data, at, elements, width, page_bits, offset_size, raw, filtered, None)
            at += elements
    for n, elements in shape[direct:]:
        if at >= stored:
            return
        secondary = c.u64()
        if secondary != UNDEFINED:
            page = 1 << page_bits
            bitmap = -(-(elements // page) // 8) if elements > page else 0
            s = Cursor(source.metadata(secondary, 14 + offset_size + n * bitmap + 8 * n))
            s.expect(b"EASB")
            s.skip(10 + offset_size)
            maps = [s.take(bitmap) for _ in range(n)]
            for k in range(n):
                data = s.u64()
                if data != UNDEFINED and at + k * elements < stored:
                    yield from _data_block(source, data, at + k * elements, elements, width, page_bits, offset_size, raw, filtered, maps[k] if bitmap else None)
        at += n * elements


def _data_block(source, address: int, first: int, elements: int, width: int, page_bits: int, offset_size: int, raw: int, filtered: bool, there: bytes | None):
    Cursor(source.metadata(address, 4)).expect(b"EADB")
    at, page = address + 14 + offset_size, 1 << page_bits
    if elements <= page:
        yield _entries(source.metadata(at, elements * width), first, 1, elements, 0, width, raw, filtered)
        return
    # the prefix has a checksum of its own
    yield from _pages(source, at + 4, first, elements // page * page, page, there, width, raw, filtered)


def _tree2(source, layout: Layout, raw: int, filtered: bool) -> Iterator[Chunk]:
    rank = len(layout.chunk)
    for r in trees.v2_records(source, layout.address, (10, 11)):
        c = Cursor(r)
        address = c.u64()
        size, mask = (c.uint(len(r) - 12 - 8 * rank), c.u32()) if filtered else (raw, 0)
        yield Chunk(tuple(c.u64() * k for k in layout.chunk), address, size, mask)
