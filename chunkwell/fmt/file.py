"""The tree of a file: navigation, catalog, datasets and attributes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from ..errors import ParseError, UnsupportedError
from ..sources.bytesource import ByteSource, ReadOptions
from . import chunk_index, header, heaps, messages, superblock, trees
from .cursor import UNDEFINED, Cursor
from .messages import Attribute, Dataspace, Datatype, Filter, Layout

MAX_DEPTH = 1000


@dataclass
class Dataset:
    """Metadata of one dataset; its chunk table is read when it is first asked for."""

    source: ByteSource = field(repr=False)
    path: str
    address: int
    space: Dataspace
    dtype: Datatype
    layout: Layout
    filters: tuple[Filter, ...]
    fill: bytes | None = None

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def shape(self) -> tuple[int, ...]:
        return self.space.dims

    @property
    def ndim(self) -> int:
        return len(self.space.dims)

    @property
    def chunk_shape(self) -> tuple[int, ...] | None:
        return self.layout.chunk if self.layout.kind == "Chunked" else None

    @property
    def index_name(self) -> str | None:
        return self.layout.index if self.layout.kind == "Chunked" else None

    @property
    def filter_names(self) -> list[str]:
        return [f.name for f in self.filters]

    @property
    def is_enumeration(self) -> bool:
        return self.dtype.cls == messages.ENUM

    @property
    def string_kind(self) -> str | None:
        return {messages.STRING: f"Fixed({self.dtype.size})", messages.VARIABLE: "Variable"}.get(self.dtype.cls)

    @property
    def dtype_info(self) -> tuple[bool, bool, int]:
        """(is_float, is_signed, bytes)."""
        t = self.dtype
        if t.cls == messages.FLOAT:
            return True, True, t.size
        if t.cls == messages.FIXED:
            return False, t.signed, t.size
        return False, False, t.size if t.cls == messages.ENUM else t.element_size

    @property
    def attributes(self) -> list[Attribute]:
        return attributes_of(self.source, header.read(self.source, self.address))

    @cached_property
    def chunk_table(self) -> chunk_index.Table:
        return chunk_index.table(self.source, self.space, self.layout, bool(self.filters)) if self.layout.kind == "Chunked" else chunk_index.Table.of([], self.ndim)

    @property
    def chunks(self) -> list[chunk_index.Chunk]:
        return self.chunk_table.list()


@dataclass(frozen=True)
class Child:
    name: str
    kind: str
    address: int


def hard_links(source: ByteSource, found: list[header.Message]) -> list[tuple[str, int]] | None:
    """(name, address) of a group's hard links in stored order; None if the object is no group."""
    table = header.first(found, messages.SYMBOLS)
    if table is not None:
        c = Cursor(table.data)
        tree, heap = c.u64(), heaps.LocalHeap(source, c.u64())
        out = []
        nodes = [a for _, a in trees.v1_leaves(source, tree, 0)]
        for head, at in zip(source.metadata_many([(a, 8) for a in nodes]), nodes, strict=True):
            c = Cursor(head)
            c.expect(b"SNOD")
            c.skip(2)
            c = Cursor(source.metadata(at + 8, 40 * c.u16()))
            while c.left >= 40:
                name, address, kind = c.u64(), c.u64(), c.u32()
                c.skip(20)
                if kind != 2 and address != UNDEFINED:
                    out.append((heap.name(name), address))
        return out
    info, compact = header.first(found, messages.LINK_INFO), [m for m in found if m.kind == messages.LINK]
    if info is None and not compact:
        return None
    links = [messages.link(m.data) for m in compact]
    if info is not None:
        heap_at, index = messages.link_info(info.data)
        if heap_at != UNDEFINED:
            heap = heaps.FractalHeap(source, heap_at)
            links += [messages.link(heap.object(r[4 : 4 + heap.id_size])) for r in trees.v2_records(source, index, 5)]
    return [(x.name, x.address) for x in links if x.kind == "hard"]


def attributes_of(source: ByteSource, found: list[header.Message]) -> list[Attribute]:
    """Attributes in the header, then those in the dense store."""
    out = []
    for m in found:
        if m.kind == messages.ATTRIBUTE:
            if m.shared:
                raise UnsupportedError("shared attribute message")
            out.append(messages.attribute(m.data))
    info = header.first(found, messages.ATTRIBUTE_INFO)
    if info is not None:
        heap_at, index = messages.attribute_info(info.data)
        if heap_at != UNDEFINED:
            heap = heaps.FractalHeap(source, heap_at)
            out += [messages.attribute(heap.object(r[: heap.id_size])) for r in trees.v2_records(source, index, 8)]
    return out


def is_dataset(found: list[header.Message]) -> bool:
    kinds = {m.kind for m in found}
    return {messages.DATASPACE, messages.DATATYPE, messages.LAYOUT} <= kinds


def build(source: ByteSource, path: str, address: int, found: list[header.Message]) -> Dataset:
    space = messages.dataspace(header.own(found, messages.DATASPACE, "dataspace").data)
    dtype = messages.datatype(header.own(found, messages.DATATYPE, "datatype").data)
    layout = messages.layout(header.own(found, messages.LAYOUT, "layout").data)
    pipeline = header.own(found, messages.FILTERS, "filter pipeline")
    fill = header.first(found, messages.FILL)
    if layout.kind == "Chunked" and len(layout.chunk) != len(space.dims):
        raise ParseError(f"chunks of rank {len(layout.chunk)} in a dataset of rank {len(space.dims)}")
    return Dataset(source, path, address, space, dtype, layout, messages.filters(pipeline.data) if pipeline else (), messages.fill_value(fill.data) if fill and not fill.shared else None)


class H5File:
    def __init__(self, path: str | bytes, options: ReadOptions | None = None):
        self.path = path if isinstance(path, str) else "memory"
        self.source = ByteSource.open(path, options)
        self.superblock = superblock.parse(self.source.metadata(0, superblock.WINDOW))

    def __enter__(self) -> H5File:
        return self

    def __exit__(self, *exc) -> None:
        self.source.close()

    @property
    def stats(self):
        return self.source.stats

    def headers(self, address: int) -> list[header.Message]:
        return header.read(self.source, address)

    def navigate(self, path: str) -> int | None:
        """Address of the object at a path of names; each name takes the first match.  None if there is none."""
        at = self.superblock.root
        for name in [p for p in path.split("/") if p]:
            links = hard_links(self.source, self.headers(at))
            at = next((a for n, a in links or () if n == name), None)
            if at is None:
                return None
        return at

    def dataset(self, path: str) -> Dataset | None:
        """None for a path that is missing, empty or not a dataset."""
        at = self.navigate(path) if path.strip("/") else None
        if at is None:
            return None
        found = self.headers(at)
        return build(self.source, "/" + path.strip("/"), at, found) if is_dataset(found) else None

    def children(self, address: int) -> list[Child]:
        """Children by name; an object that is not a group counts as a dataset."""
        links = hard_links(self.source, self.headers(address)) or []
        self.source.metadata_many([(a, 512) for _, a in links])
        return sorted((Child(n, "group" if hard_links(self.source, self.headers(a)) is not None else "dataset", a) for n, a in links), key=lambda c: c.name.encode())

    def walk(self):
        """(path, kind, address, messages) of all objects but the root, each group entered once on a path of its own ancestors."""
        stack = [("", self.superblock.root, (self.superblock.root,))]
        while stack:
            prefix, address, above = stack.pop()
            links = hard_links(self.source, self.headers(address)) or []
            self.source.metadata_many([(a, 512) for _, a in links])
            for name, a in links:
                found = self.headers(a)
                group = hard_links(self.source, found) is not None
                yield f"{prefix}/{name}", "group" if group else "dataset" if is_dataset(found) else "other", a, found
                if group and a not in above and len(above) < MAX_DEPTH:  # a cycle of links ends here
                    stack.append((f"{prefix}/{name}", a, (*above, a)))

    def datasets(self) -> list[Dataset]:
        """All datasets by path; one that can't be described fails the listing."""
        out = [build(self.source, path, a, found) for path, kind, a, found in self.walk() if kind == "dataset"]
        for d in out:
            _ = d.dtype_info  # raises for classes without an element size
        return sorted(out, key=lambda d: d.path.encode())

    def attributes(self, path: str = "") -> list[Attribute] | None:
        at = self.navigate(path)
        return None if at is None else attributes_of(self.source, self.headers(at))
