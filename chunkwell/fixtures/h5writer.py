"""A writer of small HDF5 files for tests and for staging query inputs.

It shares no code with the reader.  `earliest` files have superblock 0, version 1 headers, symbol tables
and version 1 trees; `latest` ones have superblock 3, version 2 headers, link messages or dense
storage, and the newer chunk indexes.  No independent library has confirmed these files; they follow the public
format specification.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from itertools import product

import numpy as np

NONE = 0xFFFFFFFFFFFFFFFF
UNLIMITED = NONE


def lookup3(data: bytes, initial: int = 0) -> int:
    """Jenkins' 32-bit lookup3 hash, the format's checksum."""
    mask = 0xFFFFFFFF
    rot = lambda x, k: (x << k | x >> (32 - k)) & mask
    a = b = c = (0xDEADBEEF + len(data) + initial) & mask
    at, left = 0, len(data)
    if not left:
        return c
    while left > 12:
        x, y, z = struct.unpack_from("<III", data, at)
        a, b, c = (a + x) & mask, (b + y) & mask, (c + z) & mask
        for first, k in ((0, 4), (1, 6), (2, 8), (0, 16), (1, 19), (2, 4)):
            if first == 0:
                a = ((a - c) & mask) ^ rot(c, k)
                c = (c + b) & mask
            elif first == 1:
                b = ((b - a) & mask) ^ rot(a, k)
                a = (a + c) & mask
            else:
                c = ((c - b) & mask) ^ rot(b, k)
                b = (b + a) & mask
        at, left = at + 12, left - 12
    x, y, z = struct.unpack("<III", data[at:].ljust(12, b"\0"))
    a, b, c = (a + x) & mask, (b + y) & mask, (c + z) & mask
    for u, v, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        val = {"a": a, "b": b, "c": c}
        new = ((val[u] ^ val[v]) - rot(val[v], k)) & mask
        if u == "a":
            a = new
        elif u == "b":
            b = new
        else:
            c = new
    return c


def checked(raw: bytes) -> bytes:
    return raw + struct.pack("<I", lookup3(raw))


def checked_rows(rows: np.ndarray) -> np.ndarray:
    """The same of many blocks of one length, a row of bytes each: all rows take a step of the hash at once."""
    n, length = rows.shape
    padded = np.zeros((n, length + -length % 12), "u1")
    padded[:, :length] = rows
    words = padded.view("<u4")
    rot = lambda x, k: x << np.uint32(k) | x >> np.uint32(32 - k)
    a = b = c = np.full(n, (0xDEADBEEF + length) & 0xFFFFFFFF, "u4")
    for at in range(0, words.shape[1], 3):
        a, b, c = a + words[:, at], b + words[:, at + 1], c + words[:, at + 2]
        if at + 3 < words.shape[1]:
            a = (a - c) ^ rot(c, 4)
            c = c + b
            b = (b - a) ^ rot(a, 6)
            a = a + c
            c = (c - b) ^ rot(b, 8)
            b = b + a
            a = (a - c) ^ rot(c, 16)
            c = c + b
            b = (b - a) ^ rot(a, 19)
            a = a + c
            c = (c - b) ^ rot(b, 4)
            b = b + a
    if length:
        c = (c ^ b) - rot(b, 14)
        a = (a ^ c) - rot(c, 11)
        b = (b ^ a) - rot(a, 25)
        c = (c ^ b) - rot(b, 16)
        a = (a ^ c) - rot(c, 4)
        b = (b ^ a) - rot(a, 14)
        c = (c ^ b) - rot(b, 24)
    return np.concatenate([rows, c.astype("<u4").reshape(n, 1).view("u1")], axis=1)


@dataclass
class Vl:
    """Variable-length strings: an array of text."""

    values: list
    shape: tuple = ()


@dataclass
class Fixed:
    """Fixed strings with a width and a padding (0 NUL-terminated, 1 NUL-padded, 2 space-padded)."""

    values: list
    width: int
    padding: int = 1
    shape: tuple = ()


@dataclass
class Enum:
    values: np.ndarray
    names: tuple = ("FALSE", "TRUE")


@dataclass
class Raw:
    """Elements of a class given by its datatype message."""

    dtype: bytes
    data: bytes
    shape: tuple = ()


@dataclass
class Laid:
    """An array whose elements were put into the file by others (see spread.py).  like: an empty array of the element type; address, size and
    mask of each cell in row-major order, NONE for those without a chunk; without chunks, address is that of the first element."""

    like: object
    shape: tuple
    address: np.ndarray | int
    size: np.ndarray | None = None
    mask: np.ndarray | None = None


@dataclass
class Node:
    attrs: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)
    data: object = None
    options: dict = field(default_factory=dict)


def shape_of(v) -> tuple | None:
    if v is None:
        return None
    if isinstance(v, (Vl, Fixed)):
        return v.shape or (len(v.values),)
    if isinstance(v, Enum):
        return v.values.shape
    if isinstance(v, (Raw, Laid)):
        return v.shape
    return np.asarray(v).shape


class Writer:
    def __init__(self, latest: bool = False, superblock: int | None = None, heap_start: int = 512, heap_max_direct: int = 65536, tree_node: int = 2048):
        self.latest = latest
        self.version = superblock if superblock is not None else 3 if latest else 0
        self.root = Node()
        self.out = bytearray(2048)
        self.shift = 0  # bytes of laid data, which lie behind the first 2048
        self.heap_start, self.heap_max_direct, self.tree_node = heap_start, heap_max_direct, tree_node

    # building

    def at(self, path: str) -> Node:
        node = self.root
        for name in [p for p in path.split("/") if p]:
            node = node.children.setdefault(name, Node())
        return node

    def group(self, path: str, **attrs) -> Node:
        node = self.at(path)
        node.attrs.update(attrs)
        return node

    def dataset(self, path: str, data, attrs: dict | None = None, **options) -> Node:
        """options: chunk, deflate, shuffle, max_dims, layout (compact, contiguous), index, missing (set of cell numbers),
        masks (cell number to filter mask), fill (bytes), filters (extra ids), plain_edges, unallocated, split (continuation block)."""
        node = self.at(path)
        node.data, node.options = data, options
        node.attrs.update(attrs or {})
        return node

    def soft_link(self, path: str, target: str) -> None:
        self.at(path).options["soft"] = target

    def hard_link(self, path: str, node: Node) -> None:
        """A further name of a node, which may lie above it."""
        parent, _, name = path.rpartition("/")
        self.at(parent).children[name] = node

    def save(self, path: str) -> str:
        with open(path, "wb") as f:
            f.write(self.bytes())
        return path

    def save_around(self, path: str) -> str:
        """Into a file that has the laid data already."""
        self.finish()
        with open(path, "r+b") as f:
            f.write(self.out[:2048])
            f.seek(2048 + self.shift)
            f.write(memoryview(self.out)[2048:])
        return path

    def bytes(self) -> bytes:
        self.finish()
        return bytes(self.out)

    def finish(self) -> None:
        self.done: dict[int, int] = {}
        root = self.object(self.root)
        if self.version <= 1:
            sb = b"\x89HDF\r\n\x1a\n" + bytes([self.version, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0)
            sb += struct.pack("<HH", 32, 0) if self.version == 1 else b""
            sb += struct.pack("<QQQQ", 0, NONE, len(self.out) + self.shift, NONE) + struct.pack("<QQI20x", 0, root, 0)
        else:
            sb = checked(b"\x89HDF\r\n\x1a\n" + bytes([self.version, 8, 8, 0]) + struct.pack("<QQQQ", 0, NONE, len(self.out) + self.shift, root))
        self.out[: len(sb)] = sb

    def put(self, raw: bytes, space: int = 0) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        self.out += bytes(max(0, space - len(raw)))
        return at + self.shift

    def patch(self, at: int, raw: bytes) -> None:
        self.out[at - self.shift : at - self.shift + len(raw)] = raw

    # objects

    def object(self, node: Node) -> int:
        if id(node) in self.done:
            return self.done[id(node)]
        # reserve the address of a group first, so that links may point back to it
        reserved = self.put(bytes(64 << 10)) if node.data is None and "soft" not in node.options and any(n is node or self._above(n, node) for n in self._below(node)) else None
        if reserved is not None:
            self.done[id(node)] = reserved
        messages = self.dataset_messages(node) if node.data is not None or "null" in node.options else self.group_messages(node)
        messages += self.attribute_messages(node)
        raw = self.header(messages, node.options.get("split", 0))
        if reserved is None:
            self.done[id(node)] = self.put(raw)
        else:
            self.patch(reserved, raw)
        return self.done[id(node)]

    def _below(self, node: Node):
        return list(node.children.values())

    def _above(self, n: Node, node: Node, depth: int = 4) -> bool:
        return depth > 0 and any(c is node or self._above(c, node, depth - 1) for c in n.children.values())

    def header(self, messages: list[tuple[int, bytes]], split: int = 0) -> bytes:
        """split: this many messages at the end go to a continuation block."""
        later = messages[len(messages) - split :] if split else []
        now = messages[: len(messages) - split] if split else messages
        if not self.latest:
            frame = lambda k, d: struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8)
            if later:
                block = b"".join(frame(k, d) for k, d in later)
                now = [*now, (16, struct.pack("<QQ", self.put(block), len(block)))]
            body = b"".join(frame(k, d) for k, d in now)
            return struct.pack("<BBHII4x", 1, 0, len(messages) + bool(later), 1, len(body)) + body
        frame = lambda k, d: struct.pack("<BHB", k, len(d), 0) + d
        if later:
            block = checked(b"OCHK" + b"".join(frame(k, d) for k, d in later))
            now = [*now, (16, struct.pack("<QQ", self.put(block), len(block)))]
        body = b"".join(frame(k, d) for k, d in now)
        return checked(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body)

    # types and spaces

    def dtype(self, v) -> bytes:
        if isinstance(v, Laid):
            return self.dtype(v.like)
        if isinstance(v, Raw):
            return v.dtype
        if isinstance(v, Vl):
            return struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + self.dtype(np.zeros(1, "u1"))
        if isinstance(v, Fixed):
            return struct.pack("<BBBBI", 0x13, v.padding, 0, 0, v.width)
        if isinstance(v, Enum):
            names = b"".join((n := x.encode() + b"\0") + bytes(-len(n) % 8) for x in v.names)
            values = np.arange(len(v.names), dtype=v.values.dtype).tobytes()
            return struct.pack("<BBBBI", 0x18, len(v.names), 0, 0, v.values.dtype.itemsize) + self.dtype(v.values) + names + values
        t = np.asarray(v).dtype
        big = t.byteorder == ">"
        if t.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, big | (t.kind == "i") << 3, 0, 0, t.itemsize, 0, 8 * t.itemsize)
        size, exponent, bias = {2: (10, 5, 15), 4: (23, 8, 127), 8: (52, 11, 1023)}[t.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, 8 * t.itemsize - 1, 0, t.itemsize, 0, 8 * t.itemsize, size, exponent, 0, size, bias)

    def space(self, shape: tuple | None, max_dims: tuple | None = None) -> bytes:
        if shape is None:
            return bytes([2, 0, 0, 2])
        tail = b"".join(struct.pack("<Q", d) for d in (*shape, *(max_dims or ())))
        if self.latest:
            return bytes([2, len(shape), bool(max_dims), bool(shape)]) + tail
        return bytes([1, len(shape), bool(max_dims), 0, 0, 0, 0, 0]) + tail

    def raw(self, v) -> bytes:
        if isinstance(v, Raw):
            return v.data
        if isinstance(v, Vl):
            return self.heap_references(v.values)
        if isinstance(v, Fixed):
            fill = b" " if v.padding == 2 else b"\0"
            return b"".join((x if isinstance(x, bytes) else x.encode())[: v.width].ljust(v.width, fill) for x in v.values)
        return np.ascontiguousarray(v.values if isinstance(v, Enum) else v).tobytes()

    def heap_references(self, values: list, most: int = 60_000) -> bytes:
        refs: list[bytes] = []
        pending: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal pending, size
            if not pending:
                return
            body = b"".join(struct.pack("<HH4xQ", i + 1, 1, len(d)) + d + bytes(-len(d) % 8) for i, (_, d) in enumerate(pending))
            at = self.put(b"GCOL\x01\0\0\0" + struct.pack("<Q", 16 + len(body) + 16) + body + bytes(16))
            for i, (k, d) in enumerate(pending):
                refs[k] = struct.pack("<IQI", len(d), at, i + 1)
            pending, size = [], 0

        for x in values:
            d = x if isinstance(x, bytes) else (x or "").encode()
            refs.append(struct.pack("<IQI", 0, 0, 0))
            if d:
                if size + len(d) > most or len(pending) > 60_000:
                    flush()
                pending.append((len(refs) - 1, d))
                size += len(d) + 24
        flush()
        return b"".join(refs)

    # datasets

    def dataset_messages(self, node: Node) -> list[tuple[int, bytes]]:
        v, o = node.data, node.options
        shape = None if "null" in o else shape_of(v)
        raw, width = b"" if isinstance(v, Laid) else self.raw(v), None
        kind = self.dtype(v)
        width = struct.unpack_from("<I", kind, 4)[0]
        out = [(1, self.space(shape, o.get("max_dims"))), (3, kind)]
        if "fill" in o:
            out.append((5, bytes([3, 0x20 | 0xA]) + struct.pack("<I", len(o["fill"])) + o["fill"] if self.latest else bytes([2, 2, 2, 1]) + struct.pack("<I", len(o["fill"])) + o["fill"]))
        filters = [*o.get("filters", [])]
        if o.get("shuffle"):
            filters.append((2, (width,)))
        if o.get("deflate"):
            filters.append((1, (o["deflate"],)))
        if "chunk" in o:
            out.append((8, self.chunked(node, raw, width, filters)))
        elif o.get("layout") == "compact":
            out.append((8, bytes([3, 0]) + struct.pack("<H", len(raw)) + raw))
        elif o.get("layout") == "virtual":
            out.append((8, bytes([4, 3]) + struct.pack("<QI", NONE, 0)))
        elif isinstance(v, Laid):
            out.append((8, bytes([3, 1]) + struct.pack("<QQ", v.address, width * int(np.prod(v.shape)))))
        else:
            address = NONE if o.get("unallocated") else self.put(raw)
            out.append((8, bytes([3, 1]) + struct.pack("<QQ", address, len(raw))))
        if filters:
            if self.latest:
                body = b"".join(struct.pack("<H", i) + (struct.pack("<H", 0) if i >= 256 else b"") + struct.pack("<HH", 0, len(p)) + struct.pack(f"<{len(p)}I", *p) for i, p in filters)
                out.append((11, bytes([2, len(filters)]) + body))
            else:
                body = b"".join(struct.pack("<HHHH", i, 0, 0, len(p)) + struct.pack(f"<{len(p)}I", *p) + bytes(4 * (len(p) % 2)) for i, p in filters)
                out.append((11, bytes([1, len(filters), 0, 0, 0, 0, 0, 0]) + body))
        return out

    def chunked(self, node: Node, raw: bytes, width: int, filters: list) -> bytes:
        o, shape = node.options, shape_of(node.data)
        chunk = tuple(o["chunk"])
        index = o.get("index") or self.index_for(shape, chunk, o.get("max_dims"))
        cells = self.laid_cells(node.data, shape, chunk) if isinstance(node.data, Laid) else self.put_cells(o, raw, width, shape, chunk, filters, index)
        if index == "implicit":
            return self.layout4(chunk, width, 2, b"", int(cells["address"][0]) if len(cells) else NONE)
        dims = struct.pack(f"<{len(chunk) + 1}I", *chunk, width)
        if index == "v1":
            address = self.chunk_tree1(cells[cells["address"] != NONE], len(chunk), shape, chunk)
            return bytes([3, 2, len(chunk) + 1]) + struct.pack("<Q", address) + dims
        flags = 1 if o.get("plain_edges") else 0
        if index == "single":
            if len(cells) != 1:
                raise ValueError(f"one chunk can't hold the {len(cells)} cells of {shape}")
            _, address, size, mask = cells[0].tolist()
            return self.layout4(chunk, width, 1, struct.pack("<QI", size, mask) if filters else b"", address, flags | (2 if filters else 0))
        if index in ("fixed", "extensible"):
            linear = self.linear(cells, shape, chunk, o.get("max_dims"), bool(filters))
        if index == "fixed":
            return self.layout4(chunk, width, 3, bytes([10]), self.fixed_array(linear, bool(filters), self.total(shape, chunk, o.get("max_dims"))), flags)
        if index == "extensible":
            return self.layout4(chunk, width, 4, bytes([32, 4, 4, 16, 10]), self.extensible_array(linear, bool(filters), o.get("page_bits", 10)), flags)
        found = cells[cells["address"] != NONE]
        rows = np.zeros(len(found), [("address", "<u8"), *([("size", "<u8"), ("mask", "<u4")] if filters else []), ("at", "<u8", (len(chunk),))])
        for c in rows.dtype.names:
            rows[c] = found["at"] // np.array(chunk, "u8") if c == "at" else found[c]
        data, step = rows.tobytes(), rows.dtype.itemsize
        records = [data[i : i + step] for i in range(0, len(data), step)]
        return self.layout4(chunk, width, 5, struct.pack("<IBB", self.tree_node, 100, 40), self.tree2(11 if filters else 10, records), flags)

    def put_cells(self, o: dict, raw: bytes, width: int, shape: tuple, chunk: tuple, filters: list, index: str) -> np.ndarray:
        """Encodes and puts the cells of an array; offsets, address, size and mask of each, in row-major order."""
        whole = np.frombuffer(raw, f"V{width}").reshape(shape)
        grid = [range(0, n, c) for n, c in zip(shape, chunk, strict=True)]
        cells, block = [], bytearray()
        for k, at in enumerate(product(*grid)):
            if k in o.get("missing", ()):
                cells.append((at, NONE, 0, 0))
                continue
            box = np.zeros(chunk, f"V{width}")
            part = whole[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))]
            box[tuple(slice(0, n) for n in part.shape)] = part
            mask = o.get("masks", {}).get(k, 0)
            if o.get("plain_edges") and part.shape != chunk:
                mask = 0xFFFFFFFF
            data = self.encode(box.tobytes(), filters, mask)
            if index == "implicit":
                cells.append((at, len(block), len(data), 0))
                block += data
            else:
                cells.append((at, self.put(data), len(data), 0 if o.get("plain_edges") else mask))
        found = np.array(cells, self.cell_type(len(shape)))
        if index == "implicit":
            found["address"] += np.uint64(self.put(block))
        return found

    def cell_type(self, rank: int) -> list:
        return [("at", "<u8", (rank,)), ("address", "<u8"), ("size", "<u8"), ("mask", "<u4")]

    def laid_cells(self, v: Laid, shape: tuple, chunk: tuple) -> np.ndarray:
        grid = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
        cells = np.zeros(len(v.address), self.cell_type(len(shape)))
        rest = np.arange(len(cells), dtype="u8")
        for d in range(len(grid) - 1, -1, -1):
            cells["at"][:, d] = rest % np.uint64(grid[d]) * np.uint64(chunk[d])
            rest //= np.uint64(grid[d])
        cells["address"], cells["size"], cells["mask"] = v.address, v.size, v.mask
        return cells

    def index_for(self, shape, chunk, max_dims) -> str:
        if not self.latest:
            return "v1"
        grows = sum(m == UNLIMITED for m in max_dims or ())
        if grows > 1:
            return "tree2"
        if grows:
            return "extensible"
        return "single" if tuple(shape) == tuple(chunk) and (not max_dims or tuple(max_dims) == tuple(shape)) else "fixed"

    def layout4(self, chunk, width, index, params, address, flags=0) -> bytes:
        return bytes([4, 2, flags, len(chunk) + 1, 8]) + struct.pack(f"<{len(chunk) + 1}Q", *chunk, width) + bytes([index]) + params + struct.pack("<Q", address)

    def encode(self, data: bytes, filters: list, mask: int) -> bytes:
        for k, (which, values) in enumerate(filters):
            if mask >> k & 1:
                continue
            if which == 2 and values[0] > 1:
                n = len(data) // values[0]
                data = np.frombuffer(data, "u1", n * values[0]).reshape(n, values[0]).T.tobytes() + data[n * values[0] :]
            elif which == 1:
                data = zlib.compress(data, values[0])
        return data

    def limits(self, shape, max_dims):
        return [n if m == UNLIMITED else m for n, m in zip(shape, max_dims or shape, strict=True)]

    def total(self, shape, chunk, max_dims) -> int:
        n = 1
        for d, c in zip(self.limits(shape, max_dims), chunk, strict=True):
            n *= -(-d // c)
        return n

    def linear(self, cells: np.ndarray, shape, chunk, max_dims, filtered: bool) -> np.ndarray:
        """Entries in the order of their numbers; the unlimited dimension is the slowest."""
        per = [-(-d // c) for d, c in zip(self.limits(shape, max_dims), chunk, strict=True)]
        order = list(range(len(shape)))
        grows = next((i for i, m in enumerate(max_dims or ()) if m == UNLIMITED), None)
        if grows:
            order = [grows, *[d for d in order if d != grows]]
        number = np.zeros(len(cells), "u8")
        for d in order:
            number = number * np.uint64(per[d]) + cells["at"][:, d] // np.uint64(chunk[d])
        out = np.zeros(int(number.max()) + 1 if len(cells) else 0, [("address", "<u8"), *([("size", "<u8"), ("mask", "<u4")] if filtered else [])])
        out["address"] = NONE
        for c in out.dtype.names:
            out[c][number] = cells[c]
        return out

    def filled(self, entries: np.ndarray, a: int, b: int) -> np.ndarray:
        """Entries from a to b; those beyond the last have no address."""
        part = entries[a:b]
        if len(part) == b - a:
            return part
        out = np.zeros(b - a, entries.dtype)
        out["address"] = NONE
        out[: len(part)] = part
        return out

    def paged(self, entries: np.ndarray, page: int) -> tuple[bytes, bytes]:
        """The bitmap of pages with a chunk, and the pages, each with its checksum; the last may be shorter."""
        width, pages = entries.dtype.itemsize, -(-len(entries) // page)
        full = len(entries) // page
        there = np.zeros(pages, bool)
        there[:full] = (entries["address"][: full * page].reshape(full, page) != NONE).any(axis=1)
        there[full:] = (entries["address"][full * page :] != NONE).any()
        rows = checked_rows(entries[: full * page].view("u1").reshape(full, page * width))
        rows[~there[:full]] = 0xAB  # never written
        last = entries[full * page :].tobytes()
        if last:
            last = checked(last) if there[-1] else b"\xab" * (len(last) + 4)
        return np.packbits(there).tobytes(), rows.tobytes() + last

    def fixed_array(self, entries: np.ndarray, filtered: bool, n: int) -> int:
        page, width = 1024, entries.dtype.itemsize
        header = self.put(bytes(28))
        client = int(filtered)
        entries = self.filled(entries, 0, n)
        head = b"FADB" + bytes([0, client]) + struct.pack("<Q", header)
        if n <= page:
            block = checked(head + entries.tobytes())
        else:
            bits, pages = self.paged(entries, page)
            block = checked(head + bits) + pages
        at = self.put(block)
        self.patch(header, checked(b"FAHD" + bytes([0, client, width, 10]) + struct.pack("<QQ", n, at)))
        return header

    def extensible_array(self, entries: np.ndarray, filtered: bool, page_bits: int) -> int:
        width, bits, inline, least, pointers = entries.dtype.itemsize, 32, 4, 16, 4
        used = np.flatnonzero(entries["address"] != NONE)
        n = int(used[-1]) + 1 if len(used) else 0
        header = self.put(bytes(72))
        client, off = int(filtered), 4
        page = 1 << page_bits

        def data_block(first: int, count: int) -> tuple[int, bytes]:
            head = b"EADB" + bytes([0, client]) + struct.pack("<QI", header, first - inline)
            own = self.filled(entries, first, first + count)
            if count <= page:
                return self.put(checked(head + own.tobytes())), b""
            maps, pages = self.paged(own, page)
            return self.put(checked(head) + pages), maps

        supers = 1 + bits - 4
        body = b"EAIB" + bytes([0, client]) + struct.pack("<Q", header) + self.filled(entries, 0, inline).tobytes()
        at = inline
        for u in range(supers):
            blocks, count = 1 << u // 2, (1 << (u + 1) // 2) * least
            if u < 4:  # 2 * log2(pointers)
                for _ in range(blocks):
                    body += struct.pack("<Q", data_block(at, count)[0] if at < n else NONE)
                    at += count
                continue
            if at >= n:
                body += struct.pack("<Q", NONE)
                at += blocks * count
                continue
            first = at
            maps, addresses = b"", b""
            for _ in range(blocks):
                empty = bytes(-(-(count // page) // 8)) if count > page else b""
                a, m = data_block(at, count) if at < n else (NONE, empty)
                maps, addresses, at = maps + m, addresses + struct.pack("<Q", a), at + count
            body += struct.pack("<Q", self.put(checked(b"EASB" + bytes([0, client]) + struct.pack("<QI", header, first - inline) + maps + addresses)))
        block = self.put(checked(body))
        self.patch(header, checked(b"EAHD" + bytes([0, client, width, bits, inline, least, pointers, page_bits]) + struct.pack("<6Q", 0, 0, 0, 0, n, n) + struct.pack("<Q", block)))
        return header

    def chunk_tree1(self, cells: np.ndarray, rank, shape, chunk, k: int = 32) -> int:
        end = struct.pack("<II", 0, 0) + b"".join(struct.pack("<Q", -(-n // c) * c) for n, c in zip(shape, chunk, strict=True)) + struct.pack("<Q", 0)
        if not len(cells):
            return NONE
        rows = np.zeros(len(cells), [("size", "<u4"), ("mask", "<u4"), ("at", "<u8", (rank,)), ("zero", "<u8"), ("address", "<u8")])
        for c in ("size", "mask", "at", "address"):
            rows[c] = cells[c]
        step = rows.dtype.itemsize
        # entries (key, child) one after the other, as in a node
        level, data = [], rows.tobytes()
        for i in range(0, len(rows), 2 * k):
            n = min(2 * k, len(rows) - i)
            last = data[(i + n) * step : (i + n) * step + len(end)] or end
            raw = b"TREE" + struct.pack("<BBHQQ", 1, 0, n, NONE, NONE) + data[i * step : (i + n) * step] + last
            level.append((data[i * step : i * step + len(end)], self.put(raw, 24 + 2 * k * step + len(end))))
        return level[0][1] if len(level) == 1 else self.tree1(1, level, end, 2 * k, 1)

    def tree1(self, kind: int, level: list[tuple[bytes, int]], end: bytes, most: int, depth: int = 0) -> int:
        """level: (key to the left of it, child); end: the last key."""
        while True:
            nodes = []
            for i in range(0, len(level), most):
                part = level[i : i + most]
                last = level[i + most][0] if i + most < len(level) else end
                body = b"".join(k + struct.pack("<Q", a) for k, a in part) + last
                raw = b"TREE" + struct.pack("<BBHQQ", kind, depth, len(part), NONE, NONE) + body
                nodes.append((part[0][0], self.put(raw, 24 + most * (len(end) + 8) + len(end))))
            if len(nodes) == 1:
                return nodes[0][1]
            level, depth = nodes, depth + 1

    def tree2(self, kind: int, records: list[bytes]) -> int:
        node, size = self.tree_node, len(records[0]) if records else 8
        enc = lambda x: max(1, (x.bit_length() + 7) // 8)
        most, total = [(node - 10) // size], [(node - 10) // size]
        width = enc(most[0])
        depth = 0
        while total[depth] < len(records):
            depth += 1
            p = 8 + width + (enc(total[depth - 1]) if depth > 1 else 0)
            most.append((node - 10 - p) // (size + p))
            total.append((most[depth] + 1) * total[depth - 1] + most[depth])

        def build(part: list[bytes], d: int) -> int:
            if d == 0:
                return self.put(checked(b"BTLF" + bytes([0, kind]) + b"".join(part)), node)
            children = max(2, -(-(len(part) + 1) // (total[d - 1] + 1)))
            per, cut = [], 0
            keep = children - 1
            inner = len(part) - keep
            keys, refs = b"", b""
            for i in range(children):
                n = inner // children + (i < inner % children)
                per.append(part[cut : cut + n])
                cut += n
                if i < keep:
                    keys += part[cut]
                    cut += 1
            for own in per:
                own_n = len(own) if d == 1 else max(2, -(-(len(own) + 1) // (total[d - 2] + 1))) - 1
                refs += struct.pack("<Q", build(own, d - 1)) + own_n.to_bytes(width, "little") + (len(own).to_bytes(enc(total[d - 1]), "little") if d > 1 else b"")
            return self.put(checked(b"BTIN" + bytes([0, kind]) + keys + refs), node)

        root = build(records, depth) if records else NONE
        n = len(records) if depth == 0 else max(2, -(-(len(records) + 1) // (total[depth - 1] + 1))) - 1
        return self.put(checked(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, node, size, depth, 100, 40, root, n, len(records))))

    # groups

    def group_messages(self, node: Node) -> list[tuple[int, bytes]]:
        links = sorted(node.children.items(), key=lambda x: x[0].encode())
        if not self.latest:
            return [(17, struct.pack("<QQ", *self.symbol_table([(n, NONE if "soft" in c.options else self.object(c), "soft" in c.options) for n, c in links])))]
        raws = []
        for n, c in links:
            name = n.encode()
            if "soft" in c.options:
                target = c.options["soft"].encode()
                raws.append((name, bytes([1, 8, 1, len(name)]) + name + struct.pack("<H", len(target)) + target))
            else:
                raws.append((name, bytes([1, 0, len(name)]) + name + struct.pack("<Q", self.object(c))))
        info = lambda heap, tree: (2, bytes([0, 0]) + struct.pack("<QQ", heap, tree))
        if len(raws) <= 8:
            return [info(NONE, NONE), (10, bytes([0, 0])), *((6, r) for _, r in raws)]
        heap, ids = self.fractal_heap([r for _, r in raws], 32)
        records = sorted((struct.pack("<I", lookup3(n)) + i for (n, _), i in zip(raws, ids, strict=True)), key=lambda r: struct.unpack("<I", r[:4]))
        return [info(heap, self.tree2(5, records)), (10, bytes([0, 0]))]

    def symbol_table(self, links: list[tuple[str, int, bool]]) -> tuple[int, int]:
        names, offsets = bytearray(8), []
        for n, _, _ in links:
            offsets.append(len(names))
            raw = n.encode() + b"\0"
            names += raw + bytes(-len(raw) % 8)
        segment = self.put(bytes(names))
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), 1, segment))
        level = []
        for i in range(0, len(links), 8):
            part = list(zip(offsets, links, strict=True))[i : i + 8]
            raw = b"SNOD" + struct.pack("<BBH", 1, 0, len(part)) + b"".join(struct.pack("<QQI20x", o, a, 2 if soft else 0) for o, (_, a, soft) in part)
            level.append((struct.pack("<Q", 0 if i == 0 else offsets[i - 1]), self.put(raw, 8 + 40 * 8)))
        end = struct.pack("<Q", offsets[-1] if offsets else 0)
        if not level:
            return self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 0, NONE, NONE) + bytes(8)), heap
        return self.tree1(0, level, end, 32), heap

    def attribute_messages(self, node: Node) -> list[tuple[int, bytes]]:
        raws = []
        for n, v in node.attrs.items():
            name, kind = n.encode() + b"\0", self.dtype(v)
            shape = v.shape if isinstance(v, (Vl, Fixed)) and v.shape != () else () if isinstance(v, (Vl, Fixed)) and len(v.values) == 1 and v.shape == () and getattr(v, "scalar", True) else shape_of(v)
            space, data = self.space(shape), self.raw(v)
            if self.latest:
                raws.append(struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + data)
            else:
                pad = lambda x: x + bytes(-len(x) % 8)
                raws.append(struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + data)
        if self.latest and len(raws) > 8:
            heap, ids = self.fractal_heap(raws, 40)
            records = [i + struct.pack("<BII", 0, k, k) for k, i in enumerate(ids)]
            return [(21, bytes([0, 0]) + struct.pack("<QQ", heap, self.tree2(8, records)))]
        return [(12, r) for r in raws]

    def fractal_heap(self, objects: list[bytes], bits: int) -> tuple[int, list[bytes]]:
        """Address of the header, and an id for each object."""
        width, start, most = 4, self.heap_start, self.heap_max_direct
        off = (bits + 7) // 8
        enc = lambda x: max(1, (x.bit_length() + 7) // 8)
        managed = min(most - 64, 4096)
        length = min((most.bit_length() - 1 + 7) // 8, enc(managed))
        head = 5 + 8 + off
        header = self.put(bytes(146))
        row_size = lambda r: start << max(0, r - 1)
        direct_rows = most.bit_length() - start.bit_length() + 2
        queue = list(enumerate(objects))
        ids: list[bytes] = [b""] * len(objects)
        size_of = 1 + off + length

        def direct(base: int, size: int) -> int:
            raw = b"FHDB\0" + struct.pack("<Q", header) + base.to_bytes(off, "little")
            while queue and len(raw) + len(queue[0][1]) <= size:
                k, d = queue.pop(0)
                ids[k] = b"\0" + (base + len(raw)).to_bytes(off, "little") + len(d).to_bytes(length, "little")
                raw += d
            return self.put(raw, size)

        def indirect(base: int, rows: int) -> int:
            entries = []
            at = base
            for r in range(rows):
                for _ in range(width):
                    if not queue:
                        entries.append(NONE)
                    elif r < direct_rows:
                        entries.append(direct(at, row_size(r)))
                    else:
                        entries.append(indirect(at, row_size(r).bit_length() - (start * width).bit_length() + 1))
                    at += row_size(r)
            raw = b"FHIB\0" + struct.pack("<Q", header) + base.to_bytes(off, "little") + struct.pack(f"<{len(entries)}Q", *entries)
            return self.put(checked(raw))

        total = sum(map(len, objects))
        if total + head <= start:
            root, rows = direct(0, start), 0
        else:
            rows = 1
            while width * start * (1 << (rows - 1)) * 0.5 < total + head * 8 or rows < 2:
                rows += 1
            root = indirect(0, rows)
        if queue:
            raise ValueError("heap is too small")
        raw = b"FRHP" + struct.pack("<BHHBI", 0, size_of, 0, 0, managed) + struct.pack("<12Q", 0, NONE, 0, NONE, 0, 0, 0, len(objects), 0, 0, 0, 0)
        raw += struct.pack("<HQQHHQH", width, start, most, bits, 1, root, rows)
        raw = checked(raw)
        self.patch(header, raw)
        return header, ids
