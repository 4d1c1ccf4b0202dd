"""A bounded little-endian reader."""

from __future__ import annotations

from ..errors import ParseError

#: All bits set: an address that is not there.
UNDEFINED = (1 << 64) - 1


class Cursor:
    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    @property
    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise ParseError(f"{n} bytes asked for, {self.left} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def u8(self) -> int:
        return self.uint(1)

    def u16(self) -> int:
        return self.uint(2)

    def u32(self) -> int:
        return self.uint(4)

    def u64(self) -> int:
        return self.uint(8)

    def skip(self, n: int) -> None:
        self.take(n)

    def expect(self, signature: bytes) -> None:
        got = self.take(len(signature))
        if got != signature:
            raise ParseError(f"expected {signature!r}, found {got!r}")

    def sub(self, n: int) -> Cursor:
        return Cursor(self.take(n))


def bytes_for(value: int) -> int:
    """Bytes that hold any number up to value."""
    return max(1, (value.bit_length() + 7) // 8)
