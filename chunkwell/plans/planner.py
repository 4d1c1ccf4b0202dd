"""From a dataset and a selection to input partitions.

Stored chunks that touch the selection are sorted by address and grouped into partitions: neighbours
join across a small gap until the partition has its bytes or CELLS chunks; a chunk is never cut.  They stay columns, packed, until the task
takes them apart.  Cells of the grid
without a stored chunk become fill partitions: a run of cells, and the numbers of the stored ones in it, from which the task finds the missing ones.  Contiguous data is cut into many
spans of whole outer rows, so that it reads in parallel.  All of this is arithmetic on the driver; no data is read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..errors import UnsupportedError
from ..fmt.chunk_index import Chunk, Table
from ..fmt.cursor import UNDEFINED
from ..fmt.file import Dataset
from ..sources.bytesource import ReadOptions
from . import selection
from .selection import Box

#: Cells of a fill partition, unless that makes more than FILL_PARTS of them.
FILL_CELLS, FILL_PARTS = 1 << 16, 4096
#: Stored chunks of a partition.
CELLS = 1 << 17


@dataclass(frozen=True)
class Piece:
    """A box of the selection and the bytes that hold it.  origin and shape say how the bytes are laid out."""

    box: Box
    origin: tuple[int, ...]
    shape: tuple[int, ...]
    address: int = UNDEFINED  # undefined: filled
    size: int = 0
    mask: int = 0
    data: bytes | None = None


@dataclass(frozen=True)
class Holes:
    """The cells without a stored chunk among the cells of a part of the grid, in units of cells; stored: row-major numbers in that part."""

    cells: Box
    stored: tuple[int, ...]
    box: Box
    chunk: tuple[int, ...]
    shape: tuple[int, ...]

    def pieces(self) -> Iterator[Piece]:
        there = frozenset(self.stored)
        for i, at in enumerate(selection.cells(self.cells, (1,) * len(self.cells))):
            if i not in there:
                b = selection.intersect(self.box, _extent(tuple(x * c for x, c in zip(at, self.chunk, strict=True)), self.chunk, self.shape))
                yield Piece(b, tuple(a for a, _ in b), tuple(z - a for a, z in b))


@dataclass(frozen=True)
class Stored:
    """Stored chunks that touch a box: the differences of their columns, which mostly repeat, compressed."""

    packed: bytes
    n: int
    box: Box
    chunk: tuple[int, ...]
    shape: tuple[int, ...]

    @classmethod
    def of(cls, t: Table, box: Box, chunk: tuple[int, ...], shape: tuple[int, ...]) -> Stored:
        columns = np.stack([*t.at.T, *(c.astype("u8").view("i8") for c in (t.address, t.size, t.mask))])
        return cls(zlib.compress(np.diff(columns, axis=1, prepend=0).tobytes(), 1), len(t), box, chunk, shape)

    def pieces(self) -> Iterator[Piece]:
        columns = np.cumsum(np.frombuffer(zlib.decompress(self.packed), "i8").reshape(-1, self.n), axis=1)
        for *at, address, size, mask in zip(*(c.tolist() for c in columns[:-3]), *(c.view("u8").tolist() for c in columns[-3:]), strict=True):
            yield Piece(selection.intersect(self.box, _extent(at, self.chunk, self.shape)), tuple(at), self.chunk, address, size, mask)


def expanded(group: list[Piece | Holes | Stored]) -> Iterator[Piece]:
    for p in group:
        if isinstance(p, (Holes, Stored)):
            yield from p.pieces()
        else:
            yield p


def pieces(ds: Dataset, box: Box, options: ReadOptions) -> list[list[Piece]]:
    """Groups of pieces, one for each partition; every element of box lies in exactly one piece."""
    if selection.is_empty(box) or ds.space.kind == "null":
        return []
    layout, width = ds.layout, ds.dtype.element_size
    if layout.kind == "Compact":
        return [[Piece(box, (0,) * ds.ndim, ds.shape, data=layout.data)]]
    if layout.kind == "Contiguous":
        return _contiguous(ds, box, width, options)
    if layout.kind != "Chunked":
        raise UnsupportedError(f"layout {layout.detail}")
    return _chunked(ds, box, width, options)


def _contiguous(ds: Dataset, box: Box, width: int, options: ReadOptions) -> list[list[Piece]]:
    steps = selection.strides(ds.shape)
    most = max(1, options.target(selection.volume(box) * width) // width)
    if ds.layout.address == UNDEFINED:
        return [[Piece(b, tuple(a for a, _ in b), tuple(y - x for x, y in b))] for b in _slabs(box, most)]
    out = []
    for b in _slabs(box, most, steps):
        # bytes from the first to the last selected element, as whole rows of the leading dimensions that vary
        first = sum(a * s for (a, _), s in zip(b, steps, strict=True))
        last = sum((z - 1) * s for (_, z), s in zip(b, steps, strict=True))
        out.append([Piece(b, (first,), (last - first + 1,), ds.layout.address + first * width, (last - first + 1) * width)])
    return out


def _slabs(box: Box, most: int, steps: tuple[int, ...] | None = None) -> list[Box]:
    """Cuts a box along its outermost long dimension into boxes of about most elements (of the span, if steps are given)."""
    rest = [z - a for a, z in box]
    d = next((i for i, n in enumerate(rest) if n > 1), None)
    if d is None:
        return [box]
    row = steps[d] if steps else math.prod(rest[d + 1 :])
    if row > most and d + 1 < len(box):  # one row is too long: cut inside each
        return [b for i in range(*box[d]) for b in _slabs((*box[:d], (i, i + 1), *box[d + 1 :]), most, steps)]
    n = max(1, most // max(1, row))
    a, z = box[d]
    return [(*box[:d], (i, min(i + n, z)), *box[d + 1 :]) for i in range(a, z, n)]


def _chunked(ds: Dataset, box: Box, width: int, options: ReadOptions) -> list[list[Piece]]:
    chunk = ds.layout.chunk
    grid = tuple((a // c, -(-z // c)) for (a, z), c in zip(box, chunk, strict=True))
    touched = selection.volume(grid)
    steps = selection.strides(tuple(z - a for a, z in grid))
    table = getattr(ds, "chunk_table", None)
    table = prune_table(Table.of(ds.chunks, ds.ndim) if table is None else table, box, chunk)
    # row-major numbers among the touched cells; of chunks of the same cell the first counts
    number = np.zeros(len(table), "i8" if touched < 1 << 62 else object)
    for d, ((a, _), s, c) in enumerate(zip(grid, steps, chunk, strict=True)):
        number += (table.at[:, d] // c - a).astype(number.dtype) * s
    if not (number[1:] > number[:-1]).all():
        number, first = np.unique(number, return_index=True)
        table = table.take(first)
    if not (table.address[1:] >= table.address[:-1]).all():
        table = table.take(np.argsort(table.address, kind="stable"))
    out = []
    span = options.target(int(table.size.sum()))
    for a, z in runs(table, options.gap, span):
        out.append([Stored.of(table.take(slice(a, z)), box, chunk, ds.shape)])
    # cells of the grid without a chunk
    if touched > len(table):
        cell = width * math.prod(chunk)
        most = max(1, min(FILL_CELLS, options.partition // cell), touched // FILL_PARTS)
        for part in _slabs(grid, most):  # runs of the grid's cells in row-major order
            first, n = sum((x - a) * s for (x, _), (a, _), s in zip(part, grid, steps, strict=True)), selection.volume(part)
            own = (number[slice(*np.searchsorted(number, [first, first + n]))] - first).tolist()
            if len(own) < n:
                out.append([Holes(part, tuple(own), box, chunk, ds.shape)])
    return out


def prune_table(t: Table, box: Box, chunk: tuple[int, ...]) -> Table:
    """Chunks that are there and whose cell touches the box."""
    keep = t.address != np.uint64(UNDEFINED)
    for d, ((a, z), k) in enumerate(zip(box, chunk, strict=True)):
        keep &= (t.at[:, d] < z) & (t.at[:, d] > a - k)
    return t if keep.all() else t.take(keep)


def runs(t: Table, gap: int, span: int) -> Iterator[tuple[int, int]]:
    """Chunks sorted by address, from and to: as group_requests joins them, but at most CELLS."""
    if not len(t):
        return
    ends = np.maximum.accumulate(t.address + t.size)
    breaks = np.append(np.flatnonzero(t.address[1:] > ends[:-1] + np.uint64(gap)) + 1, len(t))
    a = k = 0
    while a < len(t):
        while breaks[k] <= a:
            k += 1
        z = int(np.searchsorted(ends, t.address[a] + np.uint64(span), "right"))
        z = max(a + 1, min(z, int(breaks[k]), a + CELLS))
        yield a, z
        a = z


def _extent(at: tuple[int, ...], chunk: tuple[int, ...], shape: tuple[int, ...]) -> Box:
    """A cell clipped to the dataset."""
    return tuple((o, min(o + c, n)) for o, c, n in zip(at, chunk, shape, strict=True))


def group_requests(chunks: list[Chunk], gap: int, span: int) -> list[list[Chunk]]:
    """Chunks in the order of their addresses, joined while the gap and the span allow; one beyond the span stands alone."""
    out: list[list[Chunk]] = []
    start = end = 0
    for c in chunks:
        stop = c.address + c.size
        if out and c.address <= end + gap and max(end, stop) - start <= span:
            out[-1].append(c)
            end = max(end, stop)
        else:
            out.append([c])
            start, end = c.address, stop
    return out


def by_rows(groups: list[list[Piece | Holes]], ndim: int, target: int = 0, width: int = 1) -> list[list[Piece]]:
    """For packed rows: pieces of the same outer box come together, so that no row is split; outer boxes share a partition up to target bytes."""
    if ndim < 1:
        return [list(expanded(g)) for g in groups]
    outer: dict[Box, list[Piece]] = {}
    for g in groups:
        for p in expanded(g):
            outer.setdefault(p.box[:-1], []).append(p)
    out: list[list[Piece]] = []
    size = 0
    for _, ps in sorted(outer.items()):
        own = width * sum(selection.volume(p.box) for p in ps)
        if out and size + own <= target:
            out[-1] += sorted(ps, key=lambda p: p.box[-1])
            size += own
        else:
            out.append(sorted(ps, key=lambda p: p.box[-1]))
            size = own
    return out
