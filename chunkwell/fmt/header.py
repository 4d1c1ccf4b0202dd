"""Object headers: framing of messages in both versions, with continuation blocks."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ParseError, UnsupportedError
from .cursor import Cursor

PREFIX = 8 << 10
CONTINUATION = 16
MAX_BLOCKS = 1 << 16


@dataclass(frozen=True)
class Message:
    kind: int
    shared: bool
    data: bytes


def read(source, address: int) -> list[Message]:
    """All messages of the object at address, in the order of the file."""
    head = source.metadata(address, PREFIX)
    if head[:4] == b"OHDR":
        return _read_v2(source, address, head)
    if head[:1] == b"\x01":
        return _read_v1(source, address, head)
    if not head:
        raise ParseError(f"object header at {address} lies outside the file")
    raise UnsupportedError(f"object header at {address} of an unknown version")


def _whole(source, address: int, head: bytes, n: int) -> bytes:
    data = head if n <= len(head) else source.metadata(address, n)
    if len(data) < n:
        raise ParseError(f"object header at {address} is cut")
    return data


def _read_v1(source, address: int, head: bytes) -> list[Message]:
    c = Cursor(head)
    c.skip(8)  # version, reserved, number of messages, references
    size = c.u32()
    data = _whole(source, address, head, 16 + size)
    out: list[Message] = []
    queue, seen = [Cursor(data, 16, 16 + size)], {address}
    while queue:
        c = queue.pop(0)
        while c.left >= 8:
            kind, n, flags = c.u16(), c.u16(), c.u8()
            c.skip(3)
            _keep(source, out, queue, seen, Message(kind, bool(flags & 2), c.take(n)), 1)
    return out


def _read_v2(source, address: int, head: bytes) -> list[Message]:
    c = Cursor(head)
    c.skip(5)
    flags = c.u8()
    c.skip(16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1))
    size = c.uint(1 << (flags & 3))
    start = c.at
    data = _whole(source, address, head, start + size)
    order = 2 * (flags >> 2 & 1)
    out: list[Message] = []
    queue, seen = [Cursor(data, start, start + size)], {address}
    while queue:
        c = queue.pop(0)
        while c.left >= 4 + order:  # less than a message head is a gap
            kind, n, own = c.u8(), c.u16(), c.u8()
            c.skip(order)
            _keep(source, out, queue, seen, Message(kind, bool(own & 2), c.take(n)), 2)
    return out


def _keep(source, out: list, queue: list, seen: set, m: Message, version: int) -> None:
    if m.kind != CONTINUATION:
        out.append(m)
        return
    c = Cursor(m.data)
    at, n = c.u64(), c.u64()
    if at in seen:
        return
    seen.add(at)
    if len(seen) > MAX_BLOCKS or at + n > source.size:
        raise ParseError(f"continuation block at {at} lies outside the file")
    data = source.metadata(at, n)
    if version == 2:
        if n < 8:
            raise ParseError("continuation block is too short")
        block = Cursor(data, 0, n - 4)
        block.expect(b"OCHK")
        queue.append(block)
    else:
        queue.append(Cursor(data, 0, n))


def first(messages: list[Message], kind: int) -> Message | None:
    return next((m for m in messages if m.kind == kind), None)


def own(messages: list[Message], kind: int, what: str) -> Message | None:
    """The first message of a kind; one that lives elsewhere is not read."""
    m = first(messages, kind)
    if m is not None and m.shared:
        raise UnsupportedError(f"shared {what} message")
    return m
