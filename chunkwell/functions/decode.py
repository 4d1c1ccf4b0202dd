"""From stored chunk bytes to elements: inflate, unshuffle, filter masks, and Spark columns of the same."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CorruptError, ParseError, UnsupportedError
from ..fmt.messages import Filter

DEFLATE, SHUFFLE = 1, 2


def inflate(raw: bytes, expected: int = 0) -> bytes:
    """One zlib stream; what follows it is ignored, a cut one is an error."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(raw)
        if not d.eof:
            raise ParseError("deflate stream is cut")
    except zlib.error as e:
        raise ParseError(f"deflate: {e}") from None
    return out


def unshuffle(raw: bytes, size: int) -> bytes:
    """Bytes of equal place, stored together, back into elements of size bytes; bytes beyond whole elements come out zero."""
    if size <= 0:
        raise CorruptError("shuffle with elements of no bytes")
    n = len(raw) // size
    if size == 1:
        return raw
    planes = np.frombuffer(raw, np.uint8, n * size).reshape(size, n)
    out = np.empty((n, size), np.uint8)
    for k in range(size):  # plane by plane: several times as fast as one transposition
        out[:, k] = planes[k]
    return out.tobytes() + bytes(len(raw) - n * size)


def check_filters(filters: tuple[Filter, ...], chunked: bool) -> None:
    """All filters must be readable before anything is fetched."""
    for f in filters:
        if f.id not in (0, DEFLATE, SHUFFLE):
            raise UnsupportedError(f"filter {f.name}")
    if filters and not chunked:
        raise UnsupportedError("filters on a layout without chunks")


def needs_decode(filters: tuple[Filter, ...], mask: int) -> bool:
    return any(f.id != 0 and not mask >> k & 1 for k, f in enumerate(filters))


def decode_chunk(raw: bytes, filters: tuple[Filter, ...], mask: int, element: int, expected: int) -> bytes:
    """Undoes the filters in reverse, but for those whose mask bit is set; the result must have the chunk's size."""
    for k in range(len(filters) - 1, -1, -1):
        f = filters[k]
        if mask >> k & 1:
            continue
        if f.id == DEFLATE:
            raw = inflate(raw, expected)
        elif f.id == SHUFFLE:
            raw = unshuffle(raw, f.values[0] if f.values else element)
        elif f.id:
            raise UnsupportedError(f"filter {f.name}")
    if len(raw) != expected:
        raise CorruptError(f"chunk of {len(raw)} bytes, expected {expected}")
    return raw


def inflate_column(column: Column) -> Column:
    """BINARY to BINARY, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else inflate(bytes(x)))

    return run(column)


def unshuffle_column(column: Column, size: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unshuffle(bytes(x), size))

    return run(column)


def filter_applies(mask: Column, k: int) -> Column:
    """Whether the k-th filter of a chunk was applied when it was written."""
    return mask.bitwiseAND(F.shiftleft(F.lit(1).cast("bigint"), k)) == 0
