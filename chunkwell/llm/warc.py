"""WARC archives: writing with segments and chunked framing, reading with segment reassembly.

Writing.  A page becomes a ``response`` record whose block is an HTTP message with a chunked body,
or a ``revisit`` record when an equal payload belongs to a smaller page id.  A block longer than
``segment_bytes`` is cut: the first record carries segment number 1, ``continuation`` records follow
with the origin's id, and the last one states the total length.

Reading.  Each archive, gzipped or not, is parsed record by record.  Segments are grouped by origin
id, first within the archive and then, for those that lie apart, by a shuffle; they are ordered by number, checked
for gaps and for the total length, and joined; then the chunked framing is decoded and the payload digest is verified.

Archives are written through Spark's own writer and read through its ``binaryFile`` reader, so any
store that Spark reaches will do.  A row that is written is one record, at most a segment long, so ``ARCHIVE_RECORDS`` bounds the
bytes of an archive; an archive of others may have 2 GB at most, the limit of that reader.

Record ids name the page and the row, so that repeated rows, and rows without a page id, have records of their own.

Defined cases: null html is an empty payload; payloads below ``min_bytes`` are always responses;
repeated rows of the page with the smallest id are all responses; rows that share a page id but not a payload are decided each by
its payload; a null page id never counts as the smallest and its record carries no id; an empty table gives no rows; a long page
becomes many segments; other columns are not read; an incomplete or damaged record raises ``ValueError`` (or
is returned with an error text by ``read_archives``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, scratch_path, settled, small_side

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_RECORDS = 16 << 10, 4 << 10, 1500
VERSION, CRLF = b"WARC/1.1", b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT = "origin string, segment int, total long, kind string, headers map<string,string>, block binary"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(data: bytes) -> bytes:
    """Body of a chunked message; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size without an end")
        try:
            n = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("bad chunk size") from None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n + 2 > len(data) or data[at + n : at + n + 2] != CRLF:
            raise ValueError("cut chunk")
        out.append(data[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, sep, body = block.partition(CRLF + CRLF)
    if not sep:
        raise ValueError("HTTP head without an end")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record(kind: str, rid: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block + CRLF + CRLF


def record_id(page_id: int | None, row: int, segment: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}{f':{segment}' if segment > 1 else ''}>"


def page_of(rid: str | None) -> int | None:
    """The page id in a record id."""
    m = re.fullmatch(r"<urn:page:(-?\d+)(?::\d+)*>", rid or "")
    return int(m[1]) if m else None


def page_records(page_id: int | None, url: str | None, html: str | None, first: tuple[int, int] | None, segment_bytes: int = SEGMENT_BYTES, row: int = 0) -> list[bytes]:
    """The records of one row; first: page id and row of the response that it repeats.  Segments end between characters, so that
    every record is valid UTF-8."""
    payload = (html or "").encode()
    rid = record_id(page_id, row)
    own = [("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", len(payload))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http = ("Content-Type", "application/http;msgtype=response")
    if first is not None:
        return [record("revisit", rid, [*own, http, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first))], head + CRLF)]
    framed = b"".join((b"%x\r\n%b\r\n" % (len(c), c)) for c in pieces(payload, CHUNK_BYTES)) + b"0\r\n\r\n"
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + framed
    parts = pieces(block, segment_bytes) or [b""]
    if len(parts) == 1:
        return [record("response", rid, [*own, http], block)]
    out = [record("response", rid, [*own, http, ("WARC-Segment-Number", 1)], parts[0])]
    for i, p in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        out.append(record("continuation", record_id(page_id, row, i), [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", i), *total], p))
    return out


def pieces(raw: bytes, size: int) -> list[bytes]:
    """Cuts of at most size bytes (and at least 4) that never split a UTF-8 character."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + max(4, size))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def parse(data: bytes):
    """(headers, block) of each record; raises on damage."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            raise ValueError("record head without an end")
        head = {}
        for line in data[at:end].split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().decode().lower()] = v.strip().decode()
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or data[at : at + 4] != CRLF + CRLF:
            raise ValueError("cut record")
        at += 4
        yield head, block


def firsts_of_equal(rows: DataFrame, min_bytes: int) -> DataFrame:
    """digest, first (page_id, row): the smallest page of each payload that pages of several ids share.  Only digests are shuffled,
    once a task for each."""
    keys = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    found = keys.groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("first"), F.max("page_id").alias("last"))
    return found.where("first.page_id < last").select("digest", "first")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, compress: bool = True) -> None:
    """One record per row of pages (page_id, url, html), and continuations, as .warc files under path."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "utf-8"))))
    # the repeated payloads are few and go to the rows; beyond the broadcast's bound the rows are joined by digest
    named = rows.join(small_side(firsts_of_equal(rows, min_bytes)), "digest", "left")
    again = (F.col("page_id") > F.col("first.page_id")) & (F.octet_length("payload") >= min_bytes)
    named = named.select("page_id", "url", "payload", "row", *(F.when(again, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("page_id", "row")))

    def run(batches):
        for b in batches:
            out, size = [], 0
            for page_id, url, html, row, first, first_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in page_records(page_id, url, html, None if first is None else (first, first_row), segment_bytes, row):
                    out.append(r[:-2])  # the writer itself adds the last CRLF of each line it writes
                    size += len(r)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    named.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "gzip" if compress else "none").text(path)


def plain(content: bytes) -> bytes:
    """An archive without its gzip members, if it has any."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        if not d.eof:
            raise ValueError("gzip member is cut")
        content = d.unused_data
    return b"".join(out)


def decode(head: dict[str, str], kind: str, block: bytes) -> dict:
    """The output row of a whole record; verifies the payload digest of a response."""
    row = {"page_id": page_of(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload": None, "error": None}
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        return row | {"refers_to": page_of(head.get("warc-refers-to")), "payload_bytes": int(head["x-payload-length"]), "payload_digest": said}
    try:
        payload = http_payload(block)
    except ValueError as e:
        return row | {"payload_bytes": None, "payload_digest": None, "error": str(e)}
    found = digest(payload)
    return row | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload, "error": None if said in ("", found) else "payload digest differs"}


def joined(segments: list[tuple[int | None, int | None, bytes]]) -> bytes:
    """Blocks in the order of their numbers; raises where one is missing or the total length differs."""
    segments = sorted(set(segments), key=lambda s: s[0] or 0)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] is None:
        raise ValueError("the last segment is missing")
    if segments[-1][1] != len(block):
        raise ValueError("total length differs")
    return block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per whole record of all archives under path.  payloads=False leaves the payload column null.

    Records whose segments all lie in one archive are joined where that is read; only segments that lie apart are shuffled.
    """
    bounded_batches(spark)
    record = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
    segment = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
    both = pa.schema([*record, *segment])

    def emit(rows: list[dict], schema: pa.Schema):
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            yield pa.RecordBatch.from_pylist(part if payloads else [r | {"payload": None} for r in part], schema=schema)

    def whole(batches):
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                apart: dict[str, list[dict]] = {}
                try:
                    for head, block in parse(plain(content.as_buffer().to_pybytes() if content.is_valid else b"")):
                        kind, number = head["warc-type"], head.get("warc-segment-number")
                        if number is None:
                            if kind in ("response", "revisit"):
                                rows.append(decode(head, kind, block))
                            continue
                        origin, total = head.get("warc-segment-origin-id") or head["warc-record-id"], head.get("warc-segment-total-length")
                        apart.setdefault(origin, []).append({"origin": origin, "segment": int(number), "total": int(total) if total else None, "kind": kind, "headers": list(head.items()), "block": block})
                except (ValueError, KeyError, zlib.error) as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
                for parts in apart.values():
                    rows += [reassembled(parts)] if complete(parts) else parts
                yield from emit(rows, both)

    def late(batches):
        for b in batches:
            yield from emit([reassembled(r["parts"]) for r in b.to_pylist()], record)

    # one scan feeds both ways; what is kept has payloads only if they are asked for, and segments that lie apart
    kept = materialise(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(whole, f"{RECORD}, {SEGMENT}"), "warc-records")
    names = record.names
    grouped = kept.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "kind", "headers", "block")).alias("parts")).select("parts")
    return kept.where("origin is null").select(*names).unionByName(grouped.mapInArrow(late, RECORD))


def complete(parts: list[dict]) -> bool:
    """Whether all segments are there: numbers from 1 to that of the one that states the total length."""
    last = next((p["segment"] for p in parts if p["total"] is not None), None)
    return last is not None and sorted({p["segment"] for p in parts}) == list(range(1, last + 1))


def reassembled(parts: list[dict]) -> dict:
    """The record of an origin from its segments."""
    first = next((p for p in parts if p["kind"] != "continuation"), None)
    if first is None:
        return {"record_type": "continuation", "error": "segments without an origin"}
    try:
        return decode(dict(first["headers"]), first["kind"], joined([(p["segment"], p["total"], p["block"]) for p in parts]))
    except ValueError as e:
        return {"record_type": first["kind"], "error": str(e)}


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and return what reading them back gives, without payloads."""
    spark = pages.sparkSession

    def make() -> DataFrame:
        path = scratch_path(spark, "warc")
        write_archives(pages, path, min_bytes)
        return read_archives(spark, path, payloads=False)

    return settled(spark, "warc-read", make)
