"""Media columns in ISO base media containers.

``write_container`` stores a payload as 8-bit mono samples in a box tree (ftyp, mdat, moov).
``read_container`` walks nested boxes, decodes the sample tables and returns codec, duration and the
byte ranges of all samples and of the sync samples, without touching the media data.  The reader
takes any order of boxes, 64-bit box sizes, boxes that run to the end of the file, ``stco`` and
``co64``, ``stsz`` and ``stz2``, several tracks, and rejects sizes that leave their parent.

The byte ranges of the keyframes are a column of their own; the feature text carries their digest.

Defined cases: null text is an empty payload, padded like any other; equal texts give equal rows;
repeated rows give one row each; ids may be null; an empty table gives no rows; a long text is one container, held by one task;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

FRAME, TIMESCALE, CHUNK_FRAMES, SYNC_EVERY = 64, 8000, 16, 8
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframe_ranges array<struct<start:long,end:long>>"
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (struct.pack(">I4s", len(body) + 8, kind) if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    """raw and as many bytes 0 as make a positive multiple of unit."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def write_container(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """payload: a positive multiple of 64 bytes; each 64 bytes are one sample of the track."""
    n = len(payload) // FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = box(b"mdat", payload)
    first = len(head) + len(mdat) - len(payload)
    chunks = [first + i * FRAME for i in range(0, n, CHUNK_FRAMES)]
    last = n - (len(chunks) - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES)] * (len(chunks) > 1) + [(len(chunks), last)] * (last != CHUNK_FRAMES or len(chunks) == 1)
    offsets = full(b"stco", struct.pack(f">I{len(chunks)}I", len(chunks), *chunks)) if chunks[-1] < 1 << 32 else full(b"co64", struct.pack(f">I{len(chunks)}Q", len(chunks), *chunks))
    sync = list(range(1, n + 1, SYNC_EVERY))
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, FRAME)),
        full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        offsets,
    )
    long = n * FRAME
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, long, 0x55C4, 0), version=1),
        full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, long), bytes(8), bytes(8), matrix, bytes(8), version=1, flags=7), media)
    movie = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, long, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
    return head + mdat + box(b"moov", movie, track)


def walk(data, start: int, end: int, path: tuple = ()):
    """(path, start of the body, end) of each box, parents before children."""
    while start < end:
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _entries(data, at: int, end: int, fmt: str, n: int, width: int) -> np.ndarray:
    size = np.dtype(fmt).itemsize * width
    if n < 0 or at + n * size > end:
        raise ValueError("sample table is longer than its box")
    return np.frombuffer(data, fmt, n * width, at).reshape(n, width) if width > 1 else np.frombuffer(data, fmt, n, at)


def read_container(data: bytes) -> list[dict]:
    """Per track: codec, handler, timescale, duration, sample offsets and sizes, durations, sync sample numbers (from 0)."""
    tracks: list[dict] = []
    for path, at, end in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"sync": None})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        u32 = lambda k, at=at, end=end: struct.unpack_from(">I", data, at + k)[0] if at + k + 4 <= end else _cut()
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr":
            t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1") if u32(4) else ""
        elif kind == b"stts":
            t["stts"] = _entries(data, at + 8, end, ">u4", u32(4), 2).astype(np.int64)
        elif kind == b"stss":
            t["sync"] = _entries(data, at + 8, end, ">u4", u32(4), 1).astype(np.int64) - 1
        elif kind == b"stsc":
            t["stsc"] = _entries(data, at + 8, end, ">u4", u32(4), 3).astype(np.int64)
        elif kind == b"stsz":
            t["sizes"] = np.full(u32(8), u32(4), np.int64) if u32(4) else _entries(data, at + 12, end, ">u4", u32(8), 1).astype(np.int64)
        elif kind == b"stz2":
            n, bits = u32(8), data[at + 7]
            if bits == 4:
                raw = _entries(data, at + 12, end, "u1", (n + 1) // 2, 1)
                t["sizes"] = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
            else:
                t["sizes"] = _entries(data, at + 12, end, ">u2" if bits == 16 else "u1", n, 1).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _entries(data, at + 8, end, ">u4" if kind == b"stco" else ">u8", u32(4), 1).astype(np.int64)
    for t in tracks:
        _place(t, len(data))
    return tracks


def _cut() -> int:
    raise ValueError("cut box")


def _place(t: dict, limit: int) -> None:
    """From chunk offsets, samples per chunk and sizes to the offset of each sample."""
    sizes, chunks, runs = t.setdefault("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
    per = np.zeros(len(chunks), np.int64)
    for i, (first, n, _) in enumerate(runs):
        per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)] = n
    if per.sum() != len(sizes):
        raise ValueError("chunks and samples disagree")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    starts = np.cumsum(per) - per
    t["offsets"] = chunks[chunk] + before - before[starts[chunk]] if len(sizes) else np.zeros(0, np.int64)
    if len(sizes) and (t["offsets"].min() < 0 or (t["offsets"] + sizes).max() > limit):
        raise ValueError("a sample lies outside the file")
    if t["sync"] is None:  # without the table every sample is a sync sample
        t["sync"] = np.arange(len(sizes))
    t["sync"] = t["sync"][(t["sync"] >= 0) & (t["sync"] < len(sizes))]


def spans(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring byte ranges joined."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(offsets)]]) - 1
    return [(int(a), int(b)) for a, b in zip(offsets[first], (offsets + sizes)[last], strict=True)]


def read_payload(data: bytes, track: dict) -> bytes:
    return b"".join(data[a:b] for a, b in spans(track["offsets"], track["sizes"]))


def keyframes(track: dict) -> list[tuple[int, int]]:
    return [(int(o), int(o + s)) for o, s in zip(track["offsets"][track["sync"]], track["sizes"][track["sync"]], strict=True)]


def feature(track: dict) -> str:
    """Codec, duration and keyframe ranges as JSON; the ranges also as a digest, so that the column stays short."""
    ranges = keyframes(track)
    return json.dumps(
        {"codec": track["codec"], "handler": track["handler"], "timescale": track["timescale"], "duration": track["duration"], "samples": len(track["sizes"]), "keyframes": len(ranges), "first_keyframe": ranges[:1], "last_keyframe": ranges[-1:], "keyframe_ranges_crc32": zlib.crc32(np.array(ranges, "<u8").tobytes())},
        separators=(",", ":"),
    )


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text in a container, read it back from the stored bytes, and return digests and features."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            starts, ends, sizes = [], [], [0]
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                media = write_container(padded(raw))
                track = read_container(media)[0]
                back = read_payload(media, track)
                for o, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), track["codec"], track["duration"] / track["timescale"]), strict=True):
                    o.append(v)
                starts.append(track["offsets"][track["sync"]])
                ends.append(starts[-1] + track["sizes"][track["sync"]])
                sizes.append(sizes[-1] + len(starts[-1]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframe_ranges"]
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (starts, ends)]
            ranges = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True)), ranges], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def container_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """For stored media: codec, duration in seconds and keyframe byte ranges per track; broken files give an error text."""
    schema = "id long, track int, codec string, duration double, n_samples long, keyframe_ranges array<struct<start:long,end:long>>, error string"

    def run(batches):
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = read_container(m or b"")
                    rows += [{"id": i, "track": k, "codec": t.get("codec", ""), "duration": t["duration"] / t["timescale"] if t.get("timescale") else None, "n_samples": len(t["sizes"]), "keyframe_ranges": [{"start": x, "end": y} for x, y in keyframes(t)], "error": None} for k, t in enumerate(found)]
                except (ValueError, struct.error) as e:
                    rows.append({"id": i, "track": None, "codec": None, "duration": None, "n_samples": None, "keyframe_ranges": None, "error": str(e)})
            kind = pa.schema([("id", pa.int64()), ("track", pa.int32()), ("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframe_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(run, schema)
