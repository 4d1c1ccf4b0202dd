"""Reading bytes: stores by URI scheme, range merging, a block cache for metadata, and I/O counters."""

from __future__ import annotations

import os
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from ..errors import StoreError


@dataclass(frozen=True)
class ReadOptions:
    """Tuning of reads, in bytes where not said otherwise."""

    block: int = 512 << 10
    cache: int = 32 << 20
    span: int = 512 << 10
    gap: int = 64 << 10
    partition: int = 32 << 20
    concurrency: int = 16
    inflight: int = 32 << 20
    parallelism: int = 0  # tasks that a scan should have at least, if it is large enough

    def target(self, total: int) -> int:
        """Bytes of a partition of a scan of total bytes."""
        if not self.parallelism:
            return self.partition
        return max(min(self.partition, -(-total // self.parallelism)), min(self.partition, 1 << 20))

    @classmethod
    def of(cls, options: dict[str, str]) -> ReadOptions:
        names = {"block": "metadata_block", "cache": "metadata_cache", "span": "max_span", "gap": "max_gap", "partition": "partition_bytes", "concurrency": "io_concurrency", "inflight": "max_inflight_bytes", "parallelism": "parallelism"}
        return cls(**{k: int(options[o]) for k, o in names.items() if o in options})


@dataclass
class IoStats:
    batches: int = 0
    requests: int = 0
    bytes: int = 0
    hits: int = 0
    misses: int = 0

    def fetched(self, requests: int, size: int) -> None:
        """One wait for some requests."""
        self.batches += 1
        self.requests += requests
        self.bytes += size


def merge_ranges(ranges: Iterable[tuple[int, int]], gap: int, span: int) -> list[tuple[int, int]]:
    """Sorted covers of half-open ranges: neighbours join across at most gap bytes while the cover has at most span."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + gap and max(b, out[-1][1]) - out[-1][0] <= span:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def clamp(a: int, b: int, size: int | None) -> tuple[int, int] | None:
    """The part of a range inside the file; None if there is none.  An unknown size clips nothing."""
    if size is None:
        return a, b
    return (a, min(b, size)) if a < min(b, size) else None


class LocalStore:
    def __init__(self, path: str):
        self.path = path
        try:
            self.fd = os.open(path, os.O_RDONLY)
            self.size = os.fstat(self.fd).st_size
        except OSError as e:
            raise StoreError(f"{path}: {e.strerror}") from None

    def read(self, at: int, n: int) -> bytes:
        try:
            return os.pread(self.fd, n, at)
        except OSError as e:
            raise StoreError(f"{self.path}: {e.strerror}") from None

    def close(self) -> None:
        os.close(self.fd)


class ArrowStore:
    """Any file system that pyarrow opens by URI (s3, gs, hdfs, ...)."""

    def __init__(self, uri: str):
        from pyarrow import fs

        try:
            system, path = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(path)
            self.size = self.file.size()
        except Exception as e:
            raise StoreError(f"{uri}: {e}") from None

    def read(self, at: int, n: int) -> bytes:
        try:
            return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        except Exception as e:
            raise StoreError(str(e)) from None

    def close(self) -> None:
        self.file.close()


class HttpStore:
    """Ranges of a file behind a web server.  The size comes from a one-byte range, for signed addresses may refuse HEAD."""

    def __init__(self, url: str):
        self.url = url
        _, said = self._get(0, 1)
        total = said.rpartition("/")[2]
        if not total.isdigit():
            raise StoreError(f"{url}: the server does not serve ranges")
        self.size = int(total)

    def _get(self, at: int, n: int) -> tuple[bytes, str]:
        import urllib.error
        import urllib.request

        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={at}-{at + n - 1}"})
        try:
            with urllib.request.urlopen(ask, timeout=60) as r:
                return r.read(), r.headers.get("Content-Range", "")
        except (urllib.error.URLError, OSError) as e:
            raise StoreError(f"{self.url}: {e}") from None

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self._get(at, n)[0] if n > 0 else b""

    def close(self) -> None:
        pass


class MemoryStore:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def close(self) -> None:
        pass


_SCHEMES: dict[str, Callable[[str], object]] = {}


def register_scheme(scheme: str, opener: Callable[[str], object]) -> None:
    """Bring your own store: opener(uri) returns an object with size, read(at, n) and close()."""
    _SCHEMES[scheme] = opener


def open_store(path: str):
    u = urlparse(path)
    if u.scheme in _SCHEMES:
        return _SCHEMES[u.scheme](path)
    if u.scheme in ("", "file"):
        return LocalStore(unquote(u.path) if u.scheme else path)
    return HttpStore(path) if u.scheme in ("http", "https") else ArrowStore(path)


@dataclass
class ByteSource:
    """A file with counters and a cache of aligned metadata blocks, least recently used first out."""

    store: object
    options: ReadOptions = field(default_factory=ReadOptions)
    stats: IoStats = field(default_factory=IoStats)
    blocks: OrderedDict = field(default_factory=OrderedDict)
    held: int = 0

    @classmethod
    def open(cls, path: str | bytes, options: ReadOptions | None = None) -> ByteSource:
        return cls(MemoryStore(path) if isinstance(path, bytes) else open_store(path), options or ReadOptions())

    @property
    def size(self) -> int:
        return self.store.size

    def close(self) -> None:
        self.store.close()

    def get_range(self, a: int, b: int) -> bytes:
        """Bytes of [a, b), short or empty past the end; never cached."""
        inside = clamp(a, b, self.size)
        if inside is None:
            return b""
        data = self.store.read(inside[0], inside[1] - inside[0])
        self.stats.fetched(1, len(data))
        return data

    def stream(self, a: int, b: int, piece: int = 1 << 20):
        for at in range(a, min(b, self.size), piece):
            yield self.get_range(at, min(b, at + piece))

    def prefetch(self, requests: list[tuple[int, int]]) -> Iterator[bytes]:
        """Bytes of each request in order; those ahead are fetched by threads, at most options.inflight bytes but two requests at least."""
        if len(requests) < 2 or isinstance(self.store, MemoryStore):
            yield from (self.get_range(a, b) for a, b in requests)
            return
        with ThreadPoolExecutor(self.options.concurrency) as pool:
            ahead: deque = deque()
            held, at = 0, 0
            while ahead or at < len(requests):
                while at < len(requests) and (len(ahead) < 2 or len(ahead) < self.options.concurrency and held + requests[at][1] - requests[at][0] <= self.options.inflight):
                    a, b = requests[at]
                    inside = clamp(a, b, self.size) or (0, 0)
                    ahead.append((pool.submit(self.store.read, inside[0], inside[1] - inside[0]), b - a))
                    held, at = held + b - a, at + 1
                first, n = ahead.popleft()
                data = first.result()
                held -= n
                self.stats.fetched(1, len(data))
                yield data

    def read_ranges(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """Bytes of each range in input order, by merged requests in one batch."""
        covers = merge_ranges([r for r in ranges if r[1] > r[0]], self.options.gap, self.options.span)
        data, size = [], 0
        for a, b in covers:
            inside = clamp(a, b, self.size)
            data.append(self.store.read(inside[0], inside[1] - inside[0]) if inside else b"")
            size += len(data[-1])
        if covers:
            self.stats.fetched(len(covers), size)
        out = []
        for a, b in ranges:
            i = next((i for i, (c, d) in enumerate(covers) if c <= a and b <= d), None)
            out.append(b"" if i is None else data[i][a - covers[i][0] : b - covers[i][0]])
        return out

    def metadata(self, at: int, n: int) -> bytes:
        """At most n bytes from the block cache; one request covers all blocks that are missing."""
        if n <= 0 or at >= self.size or at < 0:
            return b""
        size = self.options.block
        first, last = at // size, (min(at + n, self.size) - 1) // size
        need = range(first, last + 1)
        missing = [k for k in need if k not in self.blocks]
        if missing:
            self.stats.misses += 1
            lo, hi = missing[0] * size, min((missing[-1] + 1) * size, self.size)
            data = self.store.read(lo, hi - lo)
            self.stats.fetched(1, len(data))
            fresh = {k: data[(k - missing[0]) * size : (k - missing[0] + 1) * size] for k in range(missing[0], missing[-1] + 1)}
        else:
            self.stats.hits += 1
            fresh = {}
        parts = []
        for k in need:
            block = fresh.get(k)
            parts.append(self.blocks[k] if block is None else block)
        for k in need:
            self._keep(k, fresh.get(k))
        data = b"".join(parts) if len(parts) > 1 else parts[0]
        return data[at - first * size : at - first * size + n]

    def _keep(self, k: int, block: bytes | None) -> None:
        if block is not None and k not in self.blocks:
            self.blocks[k] = block
            self.held += len(block)
        if k in self.blocks:
            self.blocks.move_to_end(k)
        while self.held > self.options.cache and len(self.blocks) > 1:
            self.held -= len(self.blocks.popitem(last=False)[1])

    def metadata_many(self, spans: list[tuple[int, int]]) -> list[bytes]:
        """(at, n) spans; what is not cached is brought in by few requests first."""
        size = self.options.block
        wanted = {k for at, n in spans if n > 0 and 0 <= at < self.size for k in range(at // size, (min(at + n, self.size) - 1) // size + 1)} - self.blocks.keys()
        # no more than the cache holds
        for a, b in merge_ranges([(k, k + 1) for k in wanted], 0, max(1, self.options.cache // (2 * size))):
            self.metadata(a * size, (b - a) * size)
        return [self.metadata(at, n) for at, n in spans]
