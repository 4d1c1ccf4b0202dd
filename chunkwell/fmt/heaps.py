"""Local, global and fractal heaps."""

from __future__ import annotations

from ..errors import CorruptError, ParseError, UnsupportedError
from .cursor import UNDEFINED, Cursor, bytes_for


class LocalHeap:
    """Names of a group with a symbol table."""

    def __init__(self, source, address: int):
        c = Cursor(source.metadata(address, 32))
        c.expect(b"HEAP")
        c.skip(4)
        size = c.u64()
        c.skip(8)
        at = c.u64()
        if at + size > source.size:
            raise ParseError("local heap leaves the file")
        self.data = source.metadata(at, size)

    def name(self, offset: int) -> str:
        end = self.data.find(b"\0", offset)
        if offset >= len(self.data) or end < 0:
            raise ParseError(f"no name at {offset} of the local heap")
        return self.data[offset:end].decode("utf-8", "replace")


def collection(source, address: int) -> dict[int, bytes]:
    """Objects of a global heap collection by index; read past the metadata cache, for it is data."""
    c = Cursor(source.get_range(address, address + 16))
    c.expect(b"GCOL")
    c.skip(4)
    size = c.u64()
    if size < 16 or address + size > source.size:
        raise CorruptError(f"heap collection at {address} leaves the file")
    c = Cursor(source.get_range(address + 16, address + size))
    out: dict[int, bytes] = {}
    while c.left >= 16:
        index = c.u16()
        if index == 0:
            break
        c.skip(6)
        n = c.u64()
        out[index] = c.take(n)
        c.skip(min(-n % 8, c.left))
    return out


class FractalHeap:
    """Managed and tiny objects; huge ones and filtered heaps are not read."""

    def __init__(self, source, address: int):
        self.source = source
        head = source.metadata(address, 512)
        c = Cursor(head)
        c.expect(b"FRHP")
        c.skip(1)
        self.id_size = c.u16()
        if c.u16():
            raise UnsupportedError("filtered fractal heap")
        self.checked = bool(c.u8() & 2)
        most_managed = c.u32()
        c.skip(8 * 12)  # huge objects, free space, counts
        self.width = c.u16()
        self.start, self.max_direct = c.u64(), c.u64()
        self.bits = c.u16()
        c.skip(2)
        self.root, self.rows = c.u64(), c.u16()
        if not self.width or not self.start or self.max_direct < self.start:
            raise ParseError("fractal heap table")
        self.offset_size = (self.bits + 7) // 8
        self.length_size = min((self.max_direct.bit_length() - 1 + 7) // 8, bytes_for(most_managed))
        #: rows of direct blocks
        self.direct_rows = self.max_direct.bit_length() - self.start.bit_length() + 2

    def object(self, heap_id: bytes) -> bytes:
        kind = heap_id[0] >> 4 & 3
        if kind == 2:
            if self.id_size <= 17:
                return heap_id[1 : 2 + (heap_id[0] & 15)]
            n = ((heap_id[0] & 15) << 8 | heap_id[1]) + 1
            return heap_id[2 : 2 + n]
        if kind == 1:
            raise UnsupportedError("huge object of a fractal heap")
        c = Cursor(heap_id, 1)
        return self._managed(c.uint(self.offset_size), c.uint(self.length_size))

    def _row_size(self, row: int) -> int:
        return self.start << max(0, row - 1)

    def _row_offset(self, row: int) -> int:
        return 0 if row == 0 else self.width * self.start << (row - 1)

    def _managed(self, offset: int, n: int) -> bytes:
        if self.root == UNDEFINED:
            raise CorruptError("object of an empty fractal heap")
        address, rows, base = self.root, self.rows, 0
        while rows:  # an indirect block: find the entry that holds the offset
            inner = offset - base
            row = 0
            while row + 1 < rows and inner >= self._row_offset(row + 1):
                row += 1
            size = self._row_size(row)
            column = (inner - self._row_offset(row)) // size
            if column >= self.width:
                raise CorruptError("offset outside the fractal heap")
            self._block(address, b"FHIB")
            slot = address + 13 + self.offset_size + 8 * (row * self.width + column)
            base += self._row_offset(row) + column * size
            address = Cursor(self.source.metadata(slot, 8)).u64()
            if address == UNDEFINED:
                raise CorruptError("object in a block that is not there")
            rows = 0 if row < self.direct_rows else size.bit_length() - (self.start * self.width).bit_length() + 1
        self._block(address, b"FHDB")
        data = self.source.metadata(address + offset - base, n)
        if len(data) < n:
            raise CorruptError("object leaves the file")
        return data

    def _block(self, address: int, signature: bytes) -> None:
        Cursor(self.source.metadata(address, 4)).expect(signature)
