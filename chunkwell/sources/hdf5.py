"""The `hdf5` data source: arrays, packed rows, raw elements, and catalog tables of HDF5 files.

Planning runs on the driver and reads metadata only.  A partition carries the byte ranges of its chunks, so
tasks read, decode and emit Arrow batches without any other state; a lost task reads the same bytes again.
"""

from __future__ import annotations

import fnmatch
import glob
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import CorruptError, InvalidSelectionError, StoreError, UnsupportedError
from ..fmt import messages
from ..fmt.cursor import UNDEFINED
from ..fmt.file import Dataset, H5File
from ..functions import attributes as attrs
from ..functions import decode, dtype, strings
from ..plans import planner, selection
from . import bytesource
from .bytesource import ByteSource, ReadOptions

BATCH_ROWS, RAW_BYTES = 1 << 17, 64 << 20
CATALOG = {
    "datasets": "path string, shape array<bigint>, chunk_shape array<bigint>, layout string, is_float boolean, is_signed boolean, element_bytes int, filters array<string>, index string, is_enum boolean, string_kind string",
    "objects": "path string, parent string, name string, kind string",
    "attributes": "path string, name string, kind string, str string, strs array<string>, ints array<bigint>, floats array<double>, raw binary",
    "chunks": "path string, chunk_no bigint, offsets array<bigint>, address bigint, stored_bytes bigint, filter_mask bigint",
}
IO = "part int, batches bigint, requests bigint, bytes bigint, hits bigint, misses bigint"
LISTS = pa.list_(pa.int64())
ARROW = {
    "datasets": [("path", pa.string()), ("shape", LISTS), ("chunk_shape", LISTS), ("layout", pa.string()), ("is_float", pa.bool_()), ("is_signed", pa.bool_()), ("element_bytes", pa.int32()), ("filters", pa.list_(pa.string())), ("index", pa.string()), ("is_enum", pa.bool_()), ("string_kind", pa.string())],
    "objects": [(n, pa.string()) for n in ("path", "parent", "name", "kind")],
    "attributes": [("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("str", pa.string()), ("strs", pa.list_(pa.string())), ("ints", LISTS), ("floats", pa.list_(pa.float64())), ("raw", pa.binary())],
    "chunks": [("path", pa.string()), ("chunk_no", pa.int64()), ("offsets", LISTS), ("address", pa.int64()), ("stored_bytes", pa.int64()), ("filter_mask", pa.int64())],
}


def files_of(path: str) -> list[str]:
    """A file, a folder of .h5 and .hdf5 files, a pattern, or several of these between commas."""
    out: list[str] = []
    for p in [x.strip() for x in path.split(",") if x.strip()]:
        local = p.removeprefix("file://")
        if "://" in p and not p.startswith("file://"):
            out += remote_files(p)
        elif os.path.isdir(local):
            out += sorted(f for e in ("h5", "hdf5") for f in glob.glob(os.path.join(glob.escape(local), f"*.{e}")))
        elif any(c in local for c in "*?["):
            out += sorted(glob.glob(local))
        else:
            out.append(local)
    if not out:
        raise StoreError(f"no file at {path}")
    return out


def remote_files(uri: str, system=None) -> list[str]:
    """The same of a store: a folder or a pattern is listed by the file system that pyarrow has for it; files of web servers and of one's own
    schemes stand for themselves.  system: (file system, path in it) of the part before the first wildcard."""
    from pyarrow import fs

    scheme = uri.split("://", 1)[0]
    if scheme in bytesource._SCHEMES or scheme in ("http", "https"):
        return [uri]
    wild = re.search(r"[*?\[]", uri)
    base = uri[: uri.rindex("/", 0, wild.start())] if wild else uri.rstrip("/")
    try:
        files, path = system or fs.FileSystem.from_uri(base)
        if not wild and files.get_file_info(path).type != fs.FileType.Directory:
            return [uri]
        found = [i.path for i in files.get_file_info(fs.FileSelector(path, recursive=bool(wild))) if i.type == fs.FileType.File]
    except (OSError, ValueError, NotImplementedError) as e:
        raise StoreError(f"{uri}: {e}") from None
    names = sorted(base + f[len(path) :] if path else f"{base}/{f}" for f in found)
    if not wild:
        return [n for n in names if n.endswith((".h5", ".hdf5"))]
    # a wildcard stays within its folder
    return [n for n in names if n.count("/") == uri.count("/") and fnmatch.fnmatchcase(n, uri)]


@dataclass
class FilePart(InputPartition):
    file: str | bytes


@dataclass
class ArrayPart(InputPartition):
    number: int
    file: str | bytes
    shape: tuple[int, ...]
    dtype: messages.Datatype
    filters: tuple
    fill: bytes | None
    pieces: list


class Hdf5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def _option(self, key: str, default: str = "") -> str:
        return self.options.get(key, default)

    @property
    def mode(self) -> str:
        mode = self._option("mode", "array")
        if mode not in ("array", "rows", "raw", "io", *CATALOG):
            raise ValueError(f"mode {mode}")
        return mode

    def _files(self) -> list[str]:
        if not self._option("path"):
            raise StoreError("no path")
        return files_of(self._option("path"))

    def _open(self) -> Dataset:
        name = self._option("dataset")
        with H5File(self._files()[0], ReadOptions.of(self.options)) as f:
            ds = f.dataset(name)
            if ds is None:
                raise InvalidSelectionError(f"no dataset {name!r}")
            return ds

    def schema(self) -> str:
        prefix = "file string, " if self._option("file_column") == "true" else ""
        if self.mode in CATALOG:
            return prefix + CATALOG[self.mode]
        if self.mode == "io":
            return IO
        return prefix + self._columns(self._open())

    def _columns(self, ds: Dataset) -> str:
        check_readable(ds, self.mode, self._option("dtype"))
        value = "binary" if self.mode == "raw" else dtype.spark_type(ds.dtype, self._option("u64", "decimal"), self._option("enum", "int"))
        if self.mode == "rows":
            if not ds.ndim:
                raise InvalidSelectionError("a scalar has no rows")
            return ", ".join([*(f"i{d} bigint" for d in range(ds.ndim - 1)), f"values array<{value}>"])
        coords = [f"i{d} bigint" for d in range(ds.ndim)] if self._option("coords", "true") == "true" else []
        return ", ".join([*coords, f"value {value}"])

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options.items())
        if self.mode in CATALOG:
            return CatalogReader(self.mode, options, self._files())
        pushed = self._option("pushdown") == "true" and self.mode in ("array", "rows", "raw")
        return (PushingReader if pushed else ArrayReader)(self.mode, options, self._files())


def check_readable(ds: Dataset, mode: str, wanted: str = "") -> None:
    """Filters first, then the type: what can't be read fails before anything is planned."""
    decode.check_filters(ds.filters, ds.layout.kind == "Chunked")
    if wanted:
        dtype.check(ds.dtype, wanted)
    as_bytes = mode == "raw" or ds.string_kind is not None
    if as_bytes and any(f.id == decode.SHUFFLE for f in ds.filters):
        raise UnsupportedError("bytes or strings behind a shuffle filter")
    if as_bytes:
        if ds.dtype.element_size == 0:
            raise CorruptError("elements of no bytes")
    else:
        dtype.numpy_type(ds.dtype)


class CatalogReader(DataSourceReader):
    """One task for each file."""

    def __init__(self, mode: str, options: dict[str, str], files: list[str]):
        self.mode, self.options, self.files = mode, options, files

    def partitions(self) -> list[FilePart]:
        return [FilePart(f) for f in self.files]

    def read(self, part: FilePart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # how Spark calls a scan without partitions
            return
        kind = [("file", pa.string())] * (self.options.get("file_column") == "true") + ARROW[self.mode]
        with H5File(part.file, ReadOptions.of(self.options)) as f:
            rows = list(getattr(self, self.mode)(f))
        for i in range(0, max(1, len(rows)), BATCH_ROWS):
            yield pa.RecordBatch.from_pylist([r | {"file": part.file} for r in rows[i : i + BATCH_ROWS]] if kind[0][0] == "file" else rows[i : i + BATCH_ROWS], schema=pa.schema(kind))

    def datasets(self, f: H5File):
        for d in f.datasets():
            yield info(d)

    def objects(self, f: H5File):
        rows = []
        for path, kind, _, _ in f.walk():
            parent, _, name = path.rpartition("/")
            rows.append({"path": path, "parent": parent or "/", "name": name, "kind": "group" if kind == "group" else "dataset"})
        yield from sorted(rows, key=lambda r: r["path"].encode())

    def attributes(self, f: H5File):
        only = self.options.get("object")
        at = [("/", f.superblock.root)] + [(path, a) for path, _, a, _ in f.walk()] if only is None else []
        if only is not None and (a := f.navigate(only)) is not None:
            at = [("/" + only.strip("/"), a)]
        from ..fmt.file import attributes_of

        for path, address in sorted(at, key=lambda x: x[0].encode()):
            for a in attributes_of(f.source, f.headers(address)):
                yield {"path": path, "name": a.name} | attrs.decode(f.source, a).row()

    def chunks(self, f: H5File):
        only = self.options.get("dataset")
        found = [d for d in [f.dataset(only)] if d] if only else f.datasets()
        for d in found:
            for i, c in enumerate(sorted(d.chunks, key=lambda c: c.offsets)):
                yield {"path": d.path, "chunk_no": i, "offsets": list(c.offsets), "address": c.address, "stored_bytes": c.size, "filter_mask": c.mask}


def info(d: Dataset) -> dict:
    is_float, is_signed, size = d.dtype_info
    return {"path": d.path, "shape": list(d.shape), "chunk_shape": list(d.chunk_shape) if d.chunk_shape else None, "layout": d.layout.kind, "is_float": is_float, "is_signed": is_signed, "element_bytes": size, "filters": d.filter_names, "index": d.index_name, "is_enum": d.is_enumeration, "string_kind": d.string_kind}


class ArrayReader(DataSourceReader):
    def __init__(self, mode: str, options: dict[str, str], files: list[str]):
        self.mode, self.options, self.files = mode, options, files
        self.bounds: dict[int, tuple[int, int]] = {}  # of pushed filters, by dimension

    # planning

    def box_of(self, ds: Dataset) -> selection.Box:
        ranges = selection.parse(self.options["selection"]) if "selection" in self.options else None
        box = selection.clamp(ranges, ds.shape)
        return tuple((max(a, self.bounds.get(d, (a, z))[0]), min(z, self.bounds.get(d, (a, z))[1])) for d, (a, z) in enumerate(box))

    def partitions(self) -> list[ArrayPart]:
        out: list[ArrayPart] = []
        options = ReadOptions.of(self.options)
        for file in self.files:
            with H5File(file, options) as f:
                ds = f.dataset(self.options.get("dataset", ""))
                if ds is None:
                    raise InvalidSelectionError(f"no dataset {self.options.get('dataset')!r} in {file}")
                check_readable(ds, self.mode, self.options.get("dtype", ""))
                groups = planner.pieces(ds, self.box_of(ds), options)
                if self.mode == "rows":
                    box = self.box_of(ds)
                    groups = planner.by_rows(groups, ds.ndim, options.target(selection.volume(box) * ds.dtype.element_size), ds.dtype.element_size)
                fill = ds.fill if self.options.get("fill", "zero") == "stored" else None
                out += [ArrayPart(len(out) + i, file, ds.shape, ds.dtype, ds.filters, fill, g) for i, g in enumerate(groups)]
        return out

    # reading

    def read(self, part: ArrayPart | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        options = ReadOptions.of(self.options)
        source = ByteSource.open(part.file, options)
        try:
            blocks = self._blocks(source, part, options)
            if self.mode == "io":
                for _ in blocks:
                    pass
                s = source.stats
                yield pa.RecordBatch.from_pylist([{"part": part.number, "batches": s.batches, "requests": s.requests, "bytes": s.bytes, "hits": s.hits, "misses": s.misses}], schema=pa.schema([("part", pa.int32()), *((n, pa.int64()) for n in ("batches", "requests", "bytes", "hits", "misses"))]))
                return
            cache: dict = {}
            if self.mode == "rows":
                yield from self._rows(source, part, blocks, cache)
            else:
                yield from self._elements(source, part, blocks, cache)
        finally:
            source.close()

    def _blocks(self, source: ByteSource, part: ArrayPart, options: ReadOptions) -> Iterator[tuple[selection.Box, np.ndarray]]:
        """(box, its elements as an array of that shape), with one request for neighbouring pieces of at most options.span bytes."""
        kind = np.dtype(f"V{part.dtype.element_size}")
        pieces = [x for p in part.pieces for x in (p.pieces() if isinstance(p, planner.Stored) else [p])]
        stored = [p for p in pieces if isinstance(p, planner.Piece) and p.address != UNDEFINED]
        group_of: dict[int, int] = {}  # by address, the request that brings it
        spans: list[tuple[int, int]] = []
        for group in planner.group_requests(sorted(stored, key=lambda p: p.address), options.gap, options.span):
            group_of.update((p.address, len(spans)) for p in group)
            spans.append((group[0].address, max(p.address + p.size for p in group)))
        uses = Counter(group_of[p.address] for p in stored)
        order = list(dict.fromkeys(group_of[p.address] for p in stored))  # by first use
        coming = source.prefetch([spans[g] for g in order])
        fetched = iter(order)
        held: dict[int, bytes] = {}
        for p in planner.expanded(pieces):
            dims = tuple(z - a for a, z in p.box)
            if p.data is not None:
                raw, mask = p.data, 0
                if len(raw) < math.prod(p.shape) * kind.itemsize:
                    raise CorruptError("compact data is too short")
            elif p.address == UNDEFINED:
                yield p.box, self._filled(dims, kind, part.fill)
                continue
            else:
                g = group_of[p.address]
                while g not in held:
                    held[next(fetched)] = next(coming)
                raw, mask = held[g][p.address - spans[g][0] : p.address - spans[g][0] + p.size], p.mask
                uses[g] -= 1
                if not uses[g]:
                    del held[g]
                if len(raw) < p.size:
                    raise CorruptError(f"{p.size} bytes at {p.address} leave the file")
            if len(p.shape) == 1 and len(dims) != 1 or p.data is None and not part.filters and len(p.origin) == 1 and p.shape[0] * kind.itemsize == p.size and len(part.shape) != 1:
                # a span of contiguous data
                steps = [s * kind.itemsize for s in selection.strides(part.shape)]
                yield p.box, np.lib.stride_tricks.as_strided(np.frombuffer(raw, kind), dims, steps)
                continue
            if part.filters:
                raw = decode.decode_chunk(raw, part.filters, mask, kind.itemsize, math.prod(p.shape) * kind.itemsize)
            elif p.data is None and len(raw) != math.prod(p.shape) * kind.itemsize:
                raise CorruptError(f"chunk of {len(raw)} bytes, expected {math.prod(p.shape) * kind.itemsize}")
            whole = np.frombuffer(raw, kind, math.prod(p.shape)).reshape(p.shape)
            yield p.box, whole[tuple(slice(a - o, z - o) for (a, z), o in zip(p.box, p.origin, strict=True))]

    def _filled(self, dims: tuple[int, ...], kind: np.dtype, fill: bytes | None) -> np.ndarray:
        if fill and len(fill) == kind.itemsize:
            return np.full(dims, np.frombuffer(fill, kind)[0], kind)
        return np.zeros(dims, kind)

    def _values(self, source: ByteSource, part: ArrayPart, flat: np.ndarray, cache: dict) -> pa.Array:
        """A column of flat elements."""
        t = part.dtype
        if self.mode == "raw":
            size = flat.dtype.itemsize  # all elements are of one size: the offsets are arithmetic
            return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(flat.tobytes())])
        if t.cls == messages.STRING:
            return pa.array(strings.fixed_strings(flat.tobytes(), t.size), pa.string())
        if t.cls == messages.VARIABLE:
            return pa.array(strings.vl_strings(source, flat.tobytes(), cache), pa.string())
        spark = dtype.spark_type(t, self.options.get("u64", "decimal"), self.options.get("enum", "int"))
        return dtype.to_arrow(flat.view(dtype.numpy_type(t)), spark)

    def _elements(self, source: ByteSource, part: ArrayPart, blocks, cache: dict) -> Iterator[pa.RecordBatch]:
        """Batches of up to BATCH_ROWS elements: a large block is cut, small ones are joined."""
        coords = self.options.get("coords", "true") == "true"
        named = self.options.get("file_column") == "true"
        rows = BATCH_ROWS if self.mode != "raw" else max(1, min(BATCH_ROWS, RAW_BYTES // max(1, part.dtype.element_size)))
        held: list[tuple[selection.Box, np.ndarray, int]] = []  # box, its elements from a number on
        size = 0

        def emit() -> pa.RecordBatch:
            flat = np.concatenate([x for _, x, _ in held]) if len(held) > 1 else held[0][1]
            columns, names = [], []
            if named:
                columns, names = [pa.repeat(pa.scalar(part.file), len(flat))], ["file"]
            if coords and held[0][0]:
                each = [places(at, at + len(x), box) for box, x, at in held]
                columns += [pa.array(np.concatenate(c) if len(c) > 1 else c[0]) for c in zip(*each, strict=True)]
                names += [f"i{d}" for d in range(len(held[0][0]))]
            return pa.RecordBatch.from_arrays([*columns, self._values(source, part, flat, cache)], [*names, "value"])

        for box, values in blocks:
            flat = np.ascontiguousarray(values).reshape(-1)
            at = 0
            while at < len(flat):
                take = min(len(flat) - at, rows - size)
                held.append((box, flat[at : at + take], at))
                at, size = at + take, size + take
                if size >= rows:
                    yield emit()
                    held.clear()
                    size = 0
        if held:
            yield emit()

    def _rows(self, source: ByteSource, part: ArrayPart, blocks, cache: dict) -> Iterator[pa.RecordBatch]:
        """Blocks of one outer box, side by side along the last dimension, as a list for each row."""
        side: list[np.ndarray] = []
        outer = None

        def emit():
            whole = np.concatenate(side, axis=-1) if len(side) > 1 else side[0]
            *dims, n = whole.shape
            rows = math.prod(dims)
            flat = np.ascontiguousarray(whole).reshape(rows, n)
            step = max(1, BATCH_ROWS * 8 // max(1, n))
            names = [*(["file"] if self.options.get("file_column") == "true" else []), *(f"i{d}" for d in range(len(dims))), "values"]
            for at in range(0, rows, step):
                end = min(rows, at + step)
                columns = [pa.array([part.file] * (end - at))] * ("file" in names)
                if dims:
                    columns += [pa.array(p) for p in places(at, end, outer)]
                values = self._values(source, part, flat[at:end].reshape(-1), cache)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (end - at + 1) * n, n or 1)[: end - at + 1], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names)

        for box, values in blocks:
            if outer is not None and box[:-1] != outer:
                yield from emit()
                side = []
            outer = box[:-1]
            side.append(values)
        if side:
            yield from emit()


def places(at: int, end: int, box: selection.Box) -> list[np.ndarray]:
    """Index columns of the elements from at to end of a box in row-major order."""
    rest, out = np.arange(at, end), []
    for d in range(len(box) - 1, 0, -1):
        a, z = box[d]
        rest, own = np.divmod(rest, z - a)
        own += a
        out.append(own)
    out.append(rest + box[0][0])
    return out[::-1]


class PushingReader(ArrayReader):
    """Turns comparisons of index columns with numbers into bounds of the selection.

    Opt-in, by the option pushdown=true: Spark 4.1 keeps the reader of a DataFrame, with the filters that were pushed first, for all
    later uses of that DataFrame, so this is right only for a DataFrame that is used once.  api.where prunes without that.
    All filters also go back to Spark, so that plans of different filters differ.
    """

    def pushFilters(self, filters):
        for f in filters:
            m = re.fullmatch(r"i(\d+)", ".".join(f.attribute)) if hasattr(f, "attribute") else None
            v = getattr(f, "value", None)
            if m is not None and isinstance(f, In) and f.value and all(isinstance(x, int) for x in f.value):
                self._bound(int(m[1]), min(f.value), max(f.value) + 1)
            elif m is not None and isinstance(v, int):
                self._compare(int(m[1]), f, v)
            yield f

    def _compare(self, d: int, f, v: int) -> None:
        if isinstance(f, EqualTo):
            self._bound(d, v, v + 1)
        elif isinstance(f, GreaterThan):
            self._bound(d, v + 1, None)
        elif isinstance(f, GreaterThanOrEqual):
            self._bound(d, v, None)
        elif isinstance(f, LessThan):
            self._bound(d, None, v)
        elif isinstance(f, LessThanOrEqual):
            self._bound(d, None, v + 1)

    def _bound(self, d: int, low: int | None, high: int | None) -> None:
        a, z = self.bounds.get(d, (0, 1 << 63))
        self.bounds[d] = (max(a, low or 0), z if high is None else min(z, max(0, high)))


