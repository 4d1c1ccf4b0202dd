"""The file's first structure, in its four versions."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ParseError, UnsupportedError
from .cursor import Cursor

SIGNATURE = b"\x89HDF\r\n\x1a\n"
WINDOW = 256


@dataclass(frozen=True)
class Superblock:
    version: int
    root: int


def parse(data: bytes) -> Superblock:
    c = Cursor(data)
    if c.left < 16 or c.take(8) != SIGNATURE:
        raise ParseError("not an HDF5 file")
    version = c.u8()
    if version in (0, 1):
        c.skip(4)  # versions of free space, root entry, reserved, shared headers
        widths = c.u8(), c.u8()
        c.skip(1 + 2 + 2 + 4)  # reserved, leaf and internal sizes, flags
        if version == 1:
            c.skip(4)  # size of chunk tree nodes, reserved
        _check(widths)
        base = c.u64()
        c.skip(3 * 8 + 8)  # free space, end of file, driver; the root entry's name
        root = c.u64()
    elif version in (2, 3):
        widths = c.u8(), c.u8()
        c.skip(1)
        _check(widths)
        base = c.u64()
        c.skip(2 * 8)  # extension, end of file
        root = c.u64()
    else:
        raise UnsupportedError(f"superblock version {version}")
    if base:
        raise UnsupportedError(f"base address {base}")
    return Superblock(version, root)


def _check(widths: tuple[int, int]) -> None:
    if widths != (8, 8):
        raise UnsupportedError(f"offsets of {widths[0]} and lengths of {widths[1]} bytes")
