"""Contents of header messages."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import CorruptError, ParseError, UnsupportedError
from .cursor import UNDEFINED, Cursor

DATASPACE, LINK_INFO, DATATYPE, FILL_OLD, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 4, 5, 6, 8, 11, 12, 17, 21

FIXED, FLOAT, TIME, STRING, BITS, OPAQUE, COMPOUND, REFERENCE, ENUM, VARIABLE, ARRAY = range(11)
CLASS_NAMES = ("integer", "float", "time", "string", "bitfield", "opaque", "compound", "reference", "enumeration", "variable-length", "array")

MAX_RANK = 32


@dataclass(frozen=True)
class Dataspace:
    kind: str  # scalar, simple or null
    dims: tuple[int, ...] = ()
    max_dims: tuple[int, ...] | None = None

    @property
    def elements(self) -> int:
        return 0 if self.kind == "null" else math.prod(self.dims)


@dataclass(frozen=True)
class Datatype:
    cls: int
    size: int
    signed: bool = False
    big_endian: bool = False
    padding: int = 0  # of strings: 0 NUL-terminated, 1 NUL-padded, 2 space-padded
    base: Datatype | None = None

    @property
    def element_size(self) -> int:
        """Bytes of a stored element; a class without a plain size is not read."""
        if self.cls in (FIXED, FLOAT, STRING, ENUM):
            return self.size
        if self.cls == VARIABLE:
            return 16
        raise UnsupportedError(f"{self.describe()} elements")

    def describe(self) -> str:
        if self.cls == FIXED:
            return f"{'i' if self.signed else 'u'}{8 * self.size}"
        if self.cls == FLOAT:
            return f"f{8 * self.size}"
        if self.cls == STRING:
            return f"string of {self.size} bytes"
        return CLASS_NAMES[self.cls] if self.cls < len(CLASS_NAMES) else f"class {self.cls}"


@dataclass(frozen=True)
class Layout:
    kind: str  # Compact, Contiguous, Chunked or Unsupported
    data: bytes = b""
    address: int = UNDEFINED
    size: int = 0
    chunk: tuple[int, ...] = ()  # without the element size
    index: str = ""
    index_params: tuple[int, ...] = ()
    plain_edges: bool = False
    detail: str = ""


@dataclass(frozen=True)
class Filter:
    id: int
    values: tuple[int, ...] = ()

    @property
    def name(self) -> str:
        return {1: "Deflate", 2: "Shuffle"}.get(self.id, f"Other({self.id})")


@dataclass(frozen=True)
class Link:
    name: str
    kind: str  # hard, soft or other
    address: int = UNDEFINED


@dataclass(frozen=True)
class Attribute:
    name: str
    dtype: Datatype
    space: Dataspace
    data: bytes = field(repr=False)


def dataspace(data: bytes) -> Dataspace:
    c = Cursor(data)
    version, rank, flags = c.u8(), c.u8(), c.u8()
    if rank > MAX_RANK:
        raise ParseError(f"rank {rank}")
    if version == 1:
        c.skip(5)
        kind = "simple" if rank else "scalar"
    elif version == 2:
        kind = {0: "scalar", 1: "simple", 2: "null"}.get(c.u8())
        if kind is None:
            raise ParseError("dataspace type")
    else:
        raise UnsupportedError(f"dataspace version {version}")
    dims = tuple(c.u64() for _ in range(rank))
    limits = tuple(c.u64() for _ in range(rank)) if flags & 1 else None
    return Dataspace(kind, dims, limits) if kind == "simple" else Dataspace(kind)


def datatype(data: bytes) -> Datatype:
    return _datatype(Cursor(data), 0)


def _datatype(c: Cursor, depth: int) -> Datatype:
    if depth > 8:
        raise ParseError("datatype nests too deeply")
    cls = c.u8() & 15
    bits = c.uint(3)
    size = c.u32()
    if cls == FIXED:
        c.skip(4)
        return Datatype(cls, size, bool(bits >> 3 & 1), bool(bits & 1))
    if cls == FLOAT:
        c.skip(12)
        if bits >> 6 & 1:
            raise UnsupportedError("VAX floats")
        return Datatype(cls, size, True, bool(bits & 1))
    if cls == STRING:
        return Datatype(cls, size, padding=bits & 15)
    if cls == ENUM:
        base = _datatype(c, depth + 1)
        return Datatype(cls, size, base.signed, base.big_endian, base=base)
    if cls == VARIABLE:
        return Datatype(cls, size, padding=bits >> 4 & 15, base=_datatype(c, depth + 1))
    return Datatype(cls, size)


def layout(data: bytes) -> Layout:
    c = Cursor(data)
    version = c.u8()
    if version in (1, 2):
        rank, kind = c.u8(), c.u8()
        c.skip(5)
        address = UNDEFINED if kind == 0 else c.u64()
        dims = tuple(c.u32() for _ in range(rank))
        if kind == 0:
            return Layout("Compact", data=c.take(c.u32()))
        if kind == 1:
            return Layout("Contiguous", address=address, size=math.prod(dims))
        return _chunked(dims, address, "BTreeV1")
    kind = c.u8()
    if version not in (3, 4, 5):
        raise UnsupportedError(f"layout version {version}")
    if kind == 0:
        return Layout("Compact", data=c.take(c.u16()))
    if kind == 1:
        return Layout("Contiguous", address=c.u64(), size=c.u64())
    if kind != 2:
        return Layout("Unsupported", detail="virtual" if kind == 3 else f"class {kind}")
    if version == 3:
        rank = c.u8()
        address = c.u64()
        return _chunked(tuple(c.u32() for _ in range(rank)), address, "BTreeV1")
    flags, rank, width = c.u8(), c.u8(), c.u8()
    if not 1 <= width <= 8 or rank > MAX_RANK + 1:
        raise ParseError("chunk dimensions")
    dims = tuple(c.uint(width) for _ in range(rank))
    index = c.u8()
    params: tuple[int, ...] = ()
    if index == 1:
        params = (c.u64(), c.u32()) if flags & 2 else ()
    elif index in (3, 4, 5):
        c.skip({3: 1, 4: 5, 5: 6}[index])  # the index states these itself
    elif index != 2:
        raise UnsupportedError(f"chunk index type {index}")
    name = ("SingleChunk", "Implicit", "FixedArray", "ExtensibleArray", "BTreeV2")[index - 1]
    return _chunked(dims, c.u64(), name, params, bool(flags & 1))


def _chunked(dims: tuple[int, ...], address: int, index: str, params: tuple[int, ...] = (), plain_edges: bool = False) -> Layout:
    """The last of dims is the element's size."""
    if len(dims) < 2 or 0 in dims:
        raise CorruptError(f"chunk dimensions {dims}")
    return Layout("Chunked", address=address, size=dims[-1], chunk=dims[:-1], index=index, index_params=params, plain_edges=plain_edges)


def filters(data: bytes) -> tuple[Filter, ...]:
    c = Cursor(data)
    version, n = c.u8(), c.u8()
    if version not in (1, 2):
        raise UnsupportedError(f"filter pipeline version {version}")
    if version == 1:
        c.skip(6)
    out = []
    for _ in range(n):
        which = c.u16()
        name = c.u16() if version == 1 or which >= 256 else 0
        c.skip(2)
        count = c.u16()
        c.skip(name)
        out.append(Filter(which, tuple(c.u32() for _ in range(count))))
        if version == 1 and count % 2:
            c.skip(4)
    return tuple(out)


def fill_value(data: bytes) -> bytes | None:
    """The stored fill value's bytes, None if it is the default."""
    c = Cursor(data)
    version = c.u8()
    if version in (1, 2):
        c.skip(2)
        defined = c.u8()
        if version == 2 and not defined:
            return None
    elif version == 3:
        if not c.u8() >> 5 & 1:
            return None
    else:
        raise UnsupportedError(f"fill value version {version}")
    return c.take(c.u32()) or None


def link_info(data: bytes) -> tuple[int, int]:
    """Addresses of the fractal heap and the name index."""
    c = Cursor(data)
    c.skip(1)
    if c.u8() & 1:
        c.skip(8)
    return c.u64(), c.u64()


def attribute_info(data: bytes) -> tuple[int, int]:
    c = Cursor(data)
    c.skip(1)
    if c.u8() & 1:
        c.skip(2)
    return c.u64(), c.u64()


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def link(data: bytes) -> Link:
    c = Cursor(data)
    if c.u8() != 1:
        raise UnsupportedError("link version")
    flags = c.u8()
    kind = c.u8() if flags & 8 else 0
    c.skip(8 * (flags >> 2 & 1) + (flags >> 4 & 1))
    name = text(c.take(c.uint(1 << (flags & 3))))
    if kind == 0:
        return Link(name, "hard", c.u64())
    return Link(name, "soft" if kind == 1 else "other")


def attribute(data: bytes) -> Attribute:
    c = Cursor(data)
    version, flags = c.u8(), c.u8()
    if version not in (1, 2, 3):
        raise UnsupportedError(f"attribute version {version}")
    if version > 1 and flags & 3:
        raise UnsupportedError("attribute with a shared datatype or dataspace")
    sizes = c.u16(), c.u16(), c.u16()
    if version == 3:
        c.skip(1)
    parts = []
    for n in sizes:
        parts.append(c.take(n))
        if version == 1:
            c.skip(min(-n % 8, c.left))
    kind, space = datatype(parts[1]), dataspace(parts[2])
    want = space.elements * (16 if kind.cls == VARIABLE else kind.size)
    return Attribute(text(parts[0].split(b"\0")[0]), kind, space, c.take(min(want, c.left)))
