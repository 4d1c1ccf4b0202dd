"""Queries of the engine's own operators, each with its SQL on the parquet tables.

Every query stages the columns it needs as HDF5 and reads them back through the engine.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .fixtures.h5writer import UNLIMITED, Enum, Fixed, Vl, Writer
from .fixtures.spread import Spread, save, save_files
from .fixtures.stage import column, home, spread, staged
from .operators import arrays, heap_join, intervals
from .sources.hdf5 import ArrayReader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(api.register(spark), sf_dir)

        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


# staged files


def events(spark, sf_dir, name="events", latest=False, **options) -> str:
    """event_id (dense) is the axis; /events/value, user_id and event_id."""

    plain = {"chunk": (1000,), "shuffle": True, "deflate": 1}
    datasets = {"/events/value": Spread("value", "f8", plain | options)} | {f"/events/{c}": Spread(c, "i8", plain) for c in ("user_id", "event_id")}
    return spread(spark, sf_dir, name, "events", "event_id", datasets, lambda: Writer(latest))


def vectors(spark, sf_dir) -> str:
    return spread(spark, sf_dir, "vectors", "embeddings", "vec_id", {"/vectors": Spread("embedding", "f4", {"chunk": (128, 24), "shuffle": True, "deflate": 1}, inner=extent(spark, sf_dir))}, lambda: Writer(True))


def extent(spark, sf_dir) -> int:
    """Numbers in a vector."""
    first = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.size("embedding").alias("n")).first()
    return first.n if first else 64


# 1-d reads

_VALUES = "SELECT event_id AS i0, value FROM events"


@query(_VALUES)
def read_full_f64(spark, sf_dir):
    return api.read_full(spark, events(spark, sf_dir), "/events/value", "f64")


@query(_VALUES + " WHERE event_id >= 100 AND event_id < 950")
def read_range_1d(spark, sf_dir):
    """The filter becomes the selection; only the chunks that it touches are read."""
    return api.where(spark, events(spark, sf_dir), "/events/value", "i0 >= 100 AND i0 < 950")


@query(_VALUES + " WHERE event_id >= (SELECT count(*) - 10 FROM events)")
def range_clamped(spark, sf_dir):
    path = events(spark, sf_dir)
    n = api.list_datasets(spark, path).where("path = '/events/value'").first().shape[0]
    return api.read_range(spark, path, "/events/value", [(n - 10, n + 1000)])


@query(_VALUES + " WHERE false")
def range_empty(spark, sf_dir):
    return api.read_range(spark, events(spark, sf_dir), "/events/value", [(1 << 40, 1 << 41)])


@query(_VALUES + " WHERE event_id IN (5, 77, 640)")
def pushed_in_list(spark, sf_dir):
    return api.where(spark, events(spark, sf_dir), "/events/value", "i0 IN (5, 77, 640)")


@query(_VALUES + " WHERE value > 50 AND event_id < 800")
def residual_value_filter(spark, sf_dir):
    return api.where(spark, events(spark, sf_dir), "/events/value", "value > 50 AND i0 < 800")


# n-d reads

_VECTORS = "SELECT vec_id AS i0, CAST(k - 1 AS BIGINT) AS i1, embedding[k] AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS k)"


@query(_VECTORS)
def read_full_2d(spark, sf_dir):
    return api.read_full(spark, vectors(spark, sf_dir), "/vectors", "f32")


@query(_VECTORS + " WHERE vec_id >= 100 AND vec_id < 300 AND k - 1 >= 20 AND k - 1 < 30")
def read_range_2d(spark, sf_dir):
    return api.read_range(spark, vectors(spark, sf_dir), "/vectors", [(100, 300), (20, 30)])


@query(_VECTORS + " WHERE vec_id >= 100 AND vec_id < 300 AND k - 1 = 20")
def pushdown_2d(spark, sf_dir):
    """By Spark's own pushdown, on a DataFrame that is used once."""
    return api.read(spark, vectors(spark, sf_dir), dataset="/vectors", pushdown=True).where("i0 >= 100 AND i0 < 300 AND i1 = 20")


@query("SELECT vec_id AS i0, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[64] AS last, list_max(embedding) AS top FROM embeddings")
def rows_mode_vectors(spark, sf_dir):
    rows = api.read(spark, vectors(spark, sf_dir), "rows", dataset="/vectors")
    return rows.select("i0", F.size("values").alias("n"), F.col("values")[0].alias("first"), F.col("values")[63].alias("last"), F.array_max("values").alias("top"))


@query(_VECTORS + " WHERE vec_id % 7 = 3 AND (k - 1) % 16 = 0")
def strided_selection(spark, sf_dir):
    return arrays.strided(api.read(spark, vectors(spark, sf_dir), dataset="/vectors"), {"i0": (3, 7), "i1": (0, 16)})


@query("SELECT event_id AS i0, value FROM events WHERE event_id IN (SELECT doc_id FROM labels)")
def point_selection(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("i0"))
    return arrays.points(api.read(spark, events(spark, sf_dir), dataset="/events/value"), places)


# layouts


def customer(spark, sf_dir) -> str:
    def build() -> Writer:
        w = Writer()
        w.dataset("/count", np.float64(spark.read.parquet(f"{sf_dir}/customer.parquet").count()))
        w.dataset("/regions", column(spark, sf_dir, "region", "r_regionkey")["r_regionkey"].to_numpy(), layout="compact")
        return w

    return spread(spark, sf_dir, "customer", "customer", "c_custkey", {"/acctbal": Spread("c_acctbal", "f8"), "/nation": Spread("c_nationkey", "i4", {"chunk": (97,)})}, build)


@query("SELECT c_custkey AS i0, c_acctbal AS value FROM customer")
def layout_contiguous(spark, sf_dir):
    return api.read(spark, customer(spark, sf_dir), dataset="/acctbal", partition_bytes=4096)


@query("SELECT CAST(r_regionkey AS BIGINT) AS i0, r_regionkey AS value FROM region")
def layout_compact(spark, sf_dir):
    return api.read(spark, customer(spark, sf_dir), dataset="/regions")


@query("SELECT CAST(count(*) AS DOUBLE) AS value FROM customer")
def layout_scalar(spark, sf_dir):
    return api.read(spark, customer(spark, sf_dir), dataset="/count")


@query("SELECT c_custkey AS i0, concat(printf('%02X', c_nationkey), '000000') AS raw FROM customer")
def raw_bytes(spark, sf_dir):
    return api.read_range_bytes(spark, customer(spark, sf_dir), "/nation", [(0, 1 << 40)]).select("i0", F.hex("value").alias("raw"))


# types


def _typed(kind: str, sql_value: str) -> None:
    def f(spark, sf_dir):
        def values(keys: np.ndarray) -> np.ndarray:
            return {"u64": lambda: keys.astype("u8") + np.uint64(1 << 63), "f32": lambda: keys / 4, "f64": lambda: keys / 8}.get(kind, lambda: keys % 120 - (60 if kind[0] == "i" else 0))()

        data = Spread("c_custkey", f"{kind[0]}{int(kind[1:]) // 8}", {"chunk": (500,), "deflate": 1}, values)
        return api.read_full(spark, spread(spark, sf_dir, f"type-{kind}", "customer", "c_custkey", {"/data": data}, lambda: Writer(kind[0] == "u")), "/data", kind)

    query(f"SELECT c_custkey AS i0, CAST({sql_value} AS {SQL_TYPES[kind]}) AS value FROM customer", f"type_{kind}")(f)


SQL_TYPES = {"i8": "TINYINT", "i16": "SMALLINT", "i32": "INTEGER", "i64": "BIGINT", "u8": "SMALLINT", "u16": "INTEGER", "u32": "BIGINT", "u64": "DECIMAL(20,0)", "f32": "FLOAT", "f64": "DOUBLE"}
for _kind in SQL_TYPES:
    _typed(_kind, {"u64": "CAST(c_custkey AS DECIMAL(20,0)) + 9223372036854775808", "f32": "c_custkey / 4.0", "f64": "c_custkey / 8.0"}.get(_kind, "c_custkey % 120 - 60" if _kind[0] == "i" else "c_custkey % 120"))


# missing chunks, fill values and masks


@query("SELECT event_id AS i0, CASE WHEN event_id // 1000 IN (0, 4) THEN 0.0 ELSE value END AS value FROM events")
def missing_chunks_zero(spark, sf_dir):
    return api.read(spark, events(spark, sf_dir, "missing", missing={0, 4}, fill=struct.pack("<d", -1.5)), dataset="/events/value")


@query("SELECT event_id AS i0, CASE WHEN event_id // 1000 IN (0, 4) THEN -1.5 ELSE value END AS value FROM events")
def missing_chunks_stored_fill(spark, sf_dir):
    return api.read(spark, events(spark, sf_dir, "missing", missing={0, 4}, fill=struct.pack("<d", -1.5)), dataset="/events/value", fill="stored")


@query(_VALUES)
def filter_masks(spark, sf_dir):
    return api.read(spark, events(spark, sf_dir, "masks", masks={0: 3, 2: 1, 5: 2}), dataset="/events/value")


def sparse_labels(spark, sf_dir) -> str:
    """quality by doc_id: most cells of the axis are absent."""

    quality = Spread("quality", "i4", {"chunk": (16,), "skip_zero": True}, lambda q: q + 1)
    return spread(spark, sf_dir, "labels", "labels", "doc_id", {"/quality": quality}, lambda: Writer(True), by_key=True)


@query("SELECT i0, CAST(coalesce(quality + 1, 0) AS INTEGER) AS value FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS i0) LEFT JOIN labels ON doc_id = i0")
def sparse_axis(spark, sf_dir):
    return api.read(spark, sparse_labels(spark, sf_dir), dataset="/quality")


# strings and enumerations


def priorities(spark, sf_dir) -> str:
    return spread(spark, sf_dir, "priorities", "orders", "o_orderkey", {"/priority": Spread("o_orderpriority", Fixed([], 20, 1), {"chunk": (5000,), "deflate": 1})})


def texts(spark, sf_dir) -> str:
    return spread(spark, sf_dir, "texts", "documents", "doc_id", {"/text": Spread("text", Vl([]), {"chunk": (256,)})})


@query("SELECT o_orderkey AS i0, rtrim(o_orderpriority) AS value FROM orders")
def strings_fixed(spark, sf_dir):
    return api.read_strings(spark, priorities(spark, sf_dir), "/priority")


@query("SELECT doc_id AS i0, text AS value FROM documents")
def strings_vl(spark, sf_dir):
    return api.read_strings(spark, texts(spark, sf_dir), "/text")


@query("SELECT doc_id AS i0, text AS value FROM documents")
def vl_heap_join(spark, sf_dir):
    """The same by a join of references and heap objects."""
    return heap_join.strings(spark, texts(spark, sf_dir), "/text")


def flags(spark, sf_dir) -> str:
    return spread(spark, sf_dir, "flags", "labels", "doc_id", {"/toxic": Spread("toxic", Enum(np.zeros(0, "u1")), {"chunk": (100,), "deflate": 1})})


_PLACE = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i0, "


@query(_PLACE + "CAST(toxic AS SMALLINT) AS value FROM labels")
def enum_numbers(spark, sf_dir):
    return api.read(spark, flags(spark, sf_dir), dataset="/toxic")


@query(_PLACE + "toxic = 1 AS value FROM labels")
def enum_flags(spark, sf_dir):
    return api.read(spark, flags(spark, sf_dir), dataset="/toxic", enum="boolean")


# catalog


def tables(spark, sf_dir) -> str:
    """Groups, datasets and attributes that describe the tables."""

    def build() -> Writer:
        w = Writer(True)
        w.group("/", created=Fixed(["by hand"], 16, 1), sizes=np.array([spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("region", "nation", "customer")], "i8"))
        w.dataset("/nation/name", Fixed(column(spark, sf_dir, "nation", "n_nationkey", "n_name")["n_name"].to_pylist(), 25, 1))
        w.soft_link("/nation/alias", "/customer/key")
        w.dataset("/many", np.arange(16, dtype="u1"), {f"attr{i:03}": np.array([i * i], "i8") for i in range(40)})
        return w

    low, high, top = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.min("c_custkey"), F.max("c_custkey"), F.max("c_acctbal")).first()
    key = Spread("c_custkey", "u4", {"chunk": (100,), "shuffle": True, "deflate": 1}, attrs={"unit": Vl(["none"]), "range": np.array([low, high], "i4")})
    return spread(spark, sf_dir, "tables", "customer", "c_custkey", {"/customer/key": key, "/customer/balance": Spread("c_acctbal", "f8", attrs={"top": np.float64(top)})}, build)


@query("""
SELECT '/customer/balance' AS path, CAST(count(*) AS VARCHAR) AS shape, '-' AS chunk_shape, 'Contiguous' AS layout, true AS is_float, true AS is_signed, 8 AS element_bytes, '' AS filters, '-' AS index, false AS is_enum, '-' AS string_kind FROM customer
UNION ALL SELECT '/customer/key', CAST(count(*) AS VARCHAR), '100', 'Chunked', false, false, 4, 'Shuffle,Deflate', 'FixedArray', false, '-' FROM customer
UNION ALL SELECT '/many', '16', '-', 'Contiguous', false, false, 1, '', '-', false, '-'
UNION ALL SELECT '/nation/name', CAST(count(*) AS VARCHAR), '-', 'Contiguous', false, false, 25, '', '-', false, 'Fixed(25)' FROM nation
""")
def catalog_datasets(spark, sf_dir):
    dash = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    join = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("-")).alias(c)
    return api.list_datasets(spark, tables(spark, sf_dir)).select("path", join("shape"), join("chunk_shape"), "layout", "is_float", "is_signed", "element_bytes", join("filters"), dash("index"), "is_enum", dash("string_kind"))


@query("SELECT * FROM (VALUES ('/customer', '/', 'customer', 'group'), ('/customer/balance', '/customer', 'balance', 'dataset'), ('/customer/key', '/customer', 'key', 'dataset'), ('/many', '/', 'many', 'dataset'), ('/nation', '/', 'nation', 'group'), ('/nation/name', '/nation', 'name', 'dataset')) AS t(path, parent, name, kind)")
def catalog_objects(spark, sf_dir):
    return api.list_objects(spark, tables(spark, sf_dir))


@query("SELECT 'group' AS kind, 'balance:dataset,key:dataset' AS children")
def catalog_children(spark, sf_dir):
    found = api.open_object(spark, tables(spark, sf_dir), "customer")
    return found.select("kind", F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit(":"), c["kind"])), ",").alias("children"))


@query("""
SELECT '/' AS path, 'created' AS name, 'str' AS kind, 'by hand' AS text, '' AS ints, CAST(NULL AS DOUBLE) AS first_float
UNION ALL SELECT '/', 'sizes', 'ints', '', (SELECT count(*) FROM region) || ',' || (SELECT count(*) FROM nation) || ',' || (SELECT count(*) FROM customer), NULL
UNION ALL SELECT '/customer/key', 'unit', 'str', 'none', '', NULL
UNION ALL SELECT '/customer/key', 'range', 'ints', '', min(c_custkey) || ',' || max(c_custkey), NULL FROM customer
UNION ALL SELECT '/customer/balance', 'top', 'floats', '', '', max(c_acctbal) FROM customer
UNION ALL SELECT '/many', 'attr' || lpad(CAST(i AS VARCHAR), 3, '0'), 'ints', '', CAST(i * i AS VARCHAR), NULL FROM range(0, 40) AS t(i)
""")
def attributes_decoded(spark, sf_dir):
    from .functions.attributes import as_str

    return api.list_attributes(spark, tables(spark, sf_dir)).select("path", "name", "kind", F.coalesce(as_str(), F.lit("")).alias("text"), F.coalesce(F.array_join(F.col("ints").cast("array<string>"), ","), F.lit("")).alias("ints"), F.col("floats")[0].alias("first_float"))


@query("SELECT '/customer/balance' AS path, 8 AS element_bytes UNION ALL SELECT '/customer/key', 4 UNION ALL SELECT '/many', 1 UNION ALL SELECT '/nation/name', 25")
def catalog_udtf(spark, sf_dir):
    return spark.sql(f"SELECT path, element_bytes FROM hdf5_datasets('{tables(spark, sf_dir)}')")


# chunks

_GRID = "SELECT '/events/value' AS path, event_id // 1000 AS chunk_no, (event_id // 1000) * 1000 AS offset FROM events GROUP BY ALL"


@query(_GRID)
def chunk_table(spark, sf_dir):
    return api.list_chunks(spark, events(spark, sf_dir), dataset="/events/value").select("path", "chunk_no", F.col("offsets")[0].alias("offset"))


@query(_GRID)
def chunk_grid(spark, sf_dir):
    """Cells by arithmetic on the catalog, stored or not."""
    found = api.list_datasets(spark, events(spark, sf_dir)).where("path = '/events/value'")
    return arrays.chunk_grid(found).select("path", "chunk_no", F.col("offsets")[0].alias("offset"))


@query("SELECT doc_id // 16 AS cell, count(*) AS n FROM labels GROUP BY ALL")
def stored_cells(spark, sf_dir):
    """Cells with a chunk, and the elements in them that are set."""
    path = sparse_labels(spark, sf_dir)
    cells = api.list_chunks(spark, path, dataset="/quality").select((F.col("offsets")[0] / 16).cast("bigint").alias("cell"))
    counts = api.read(spark, path, dataset="/quality").where("value > 0").groupBy(F.expr("i0 div 16").alias("cell")).agg(F.count("*").alias("n"))
    return cells.join(counts, "cell")


@query("SELECT id, count(DISTINCT (vec_id // 128, (k - 1) // 24)) AS chunks FROM embeddings, (SELECT unnest(range(1, 65)) AS k), (VALUES (1, 0, 200, 10, 30), (2, 130, 131, 0, 64), (3, 0, 10000000, 23, 25)) AS s(id, a, b, c, d) WHERE vec_id >= a AND vec_id < b AND k - 1 >= c AND k - 1 < d GROUP BY id")
def chunk_prune_count(spark, sf_dir):
    """Chunk boxes that each selection box overlaps."""
    selections = spark.createDataFrame([(1, [0, 10], [200, 30]), (2, [130, 0], [131, 64]), (3, [0, 23], [10_000_000, 25])], "id int, lo array<bigint>, hi array<bigint>")
    chunks = api.list_chunks(spark, vectors(spark, sf_dir), dataset="/vectors")
    return arrays.touched(chunks, [128, 24], selections, 2).groupBy("id").agg(F.count("*").alias("chunks"))


def _indexed(name: str, options: dict, latest: bool = True) -> None:
    query(_VALUES, f"index_{name}")(lambda spark, sf_dir: api.read(spark, events(spark, sf_dir, f"index-{name}", latest, **options), dataset="/events/value"))


_indexed("tree1", {"chunk": (50,)}, False)
_indexed("implicit", {"chunk": (125,), "index": "implicit", "shuffle": False, "deflate": None})
_indexed("fixed", {"chunk": (100,)})
_indexed("fixed_paged", {"chunk": (4,), "shuffle": False, "deflate": None})
_indexed("extensible", {"chunk": (100,), "max_dims": (UNLIMITED,)})
_indexed("extensible_deep", {"chunk": (3,), "max_dims": (UNLIMITED,), "shuffle": False, "deflate": None, "page_bits": 5})


#: Elements of a single chunk.
SINGLE = 1 << 20


@query(_VALUES)
def index_single(spark, sf_dir):
    """An array is its only chunk, and a chunk is decoded whole by one task: so the table is cut into arrays of a bounded size, one in each file of a folder."""
    folder = f"{home(spark)}/{os.path.basename(staged(spark, sf_dir, 'marker', Writer))}-single-{SINGLE}"

    def build(values: np.ndarray) -> Writer:
        w = Writer(True)
        w.dataset("/events/value", values, **({"chunk": (len(values),), "index": "single", "shuffle": True, "deflate": 1} if len(values) else {}))
        return w

    if not os.path.isdir(folder):
        save_files(folder + ".tmp", spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "value", SINGLE, build)
        os.rename(folder + ".tmp", folder)
    number = F.regexp_extract("file", r"part(\d+)\.h5$", 1).cast("bigint")
    return api.read(spark, folder, dataset="/events/value", file_column=True).select((number * SINGLE + F.col("i0")).alias("i0"), "value")


@query(_VECTORS)
def index_tree2(spark, sf_dir):
    data = Spread("embedding", "f4", {"chunk": (16, 8), "max_dims": (UNLIMITED, UNLIMITED), "deflate": 1}, inner=extent(spark, sf_dir))
    return api.read(spark, spread(spark, sf_dir, "tree2", "embeddings", "vec_id", {"/vectors": data}, lambda: Writer(True, tree_node=512)), dataset="/vectors")


@query("SELECT 'link' || lpad(CAST(i AS VARCHAR), 5, '0') AS name FROM range(0, 1200) AS t(i)")
def dense_links(spark, sf_dir):
    def build() -> Writer:
        w = Writer(True, heap_max_direct=1024, tree_node=512)
        one = w.dataset("/one", np.arange(4))
        for i in range(1200):
            w.hard_link(f"/many/link{i:05}", one)
        return w

    return api.list_objects(spark, staged(spark, sf_dir, "dense", build)).where("parent = '/many'").select("name")


# I/O planning


@query("SELECT true AS requested, true AS covers_stored, true AS fewer_than_chunks")
def io_stats(spark, sf_dir):
    """What a read costs, as facts: some requests, all stored bytes, and not a request for each chunk."""
    path = events(spark, sf_dir)
    cost = api.io_stats(spark, path, "/events/value").agg(F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"))
    stored = api.list_chunks(spark, path).where("path = '/events/value'").agg(F.sum("stored_bytes").alias("stored"), F.count("*").alias("chunks"))
    return cost.join(stored).select((F.col("requests") >= 1).alias("requested"), (F.col("bytes") >= F.col("stored")).alias("covers_stored"), (F.col("requests") <= F.col("chunks")).alias("fewer_than_chunks"))


@query("SELECT user_id, CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(epoch(max(ts)) + 600 AS BIGINT) AS \"end\" FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, date_trunc('second', ts) AS ts, CASE WHEN epoch(date_trunc('second', ts)) <= lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts) + 600 + 3600 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g")
def coalesce_gaps(spark, sf_dir):
    """Neighbours at most a gap apart become one range, by user."""
    return intervals.merged(_spans(spark, sf_dir, 600), "user_id", 3600, 1 << 20)


_SPANS = "SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 600 AS e FROM events"
_JOINS = 'r.s <= t.e + 3600 AND greatest(r.e, t.e) - t.s <= 86400'


@query(f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM ({_SPANS})),
t AS (SELECT user_id, k, s, e, 1 AS g FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.k, CASE WHEN {_JOINS} THEN t.s ELSE r.s END, CASE WHEN {_JOINS} THEN greatest(r.e, t.e) ELSE r.e END, CASE WHEN {_JOINS} THEN t.g ELSE t.g + 1 END
  FROM t JOIN r ON r.user_id = t.user_id AND r.k = t.k + 1)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM t GROUP BY user_id, g
""")
def coalesce_capped(spark, sf_dir):
    """The same with a cap on the cover, as reads are grouped."""
    return intervals.coalesce_ranges(_spans(spark, sf_dir, 600), "user_id", 3600, 86_400)


def _spans(spark, sf_dir, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """start and end by user_id, from two staged arrays."""
    plain = {"chunk": (4096,), "deflate": 1}
    start = Spread("ts", "i8", plain, lambda t: t.astype("datetime64[s]").astype("i8"))
    path = spread(spark, sf_dir, "spans", "events", "event_id", {"/user": Spread("user_id", "i8", plain), "/start": start}, lambda: Writer(True))
    both = arrays.assemble({"user_id": api.read(spark, path, dataset="/user"), "start": api.read(spark, path, dataset="/start")})
    return both.select(*keep, "user_id", "start", (F.col("start") + width).alias("end"))


# interval analytics

_SPANS = "WITH s AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS a, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + {0} AS b FROM events)"
_MERGED = ", m{0} AS (SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {1})) GROUP BY user_id, g)"


@query(_SPANS.format(86400) + _MERGED.format("", "s") + " SELECT user_id, CAST(sum(b - a) AS BIGINT) AS covered FROM m GROUP BY user_id")
def interval_union(spark, sf_dir):
    return intervals.union_length(_spans(spark, sf_dir, 86_400), "user_id")


@query(_SPANS.format(86400) + " SELECT user_id, CAST(sum(b - a) AS BIGINT) AS total FROM s GROUP BY user_id")
def interval_total(spark, sf_dir):
    return intervals.total(_spans(spark, sf_dir, 86_400), "user_id")


@query(_SPANS.format(86400) + ", e AS (SELECT user_id, a AS tm, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s), r AS (SELECT user_id, tm, sum(d) OVER w AS k, lead(tm) OVER w - tm AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, d DESC ROWS UNBOUNDED PRECEDING)) SELECT user_id, CAST(max(k) AS BIGINT) AS peak, CAST(sum(CASE WHEN k > 0 THEN dt END) AS BIGINT) AS busy, CAST(sum(k * dt) AS BIGINT) AS open_time, CASE WHEN sum(CASE WHEN k > 0 THEN dt END) = 0 THEN 0.0 ELSE CAST(sum(k * dt) AS DOUBLE) / CAST(sum(CASE WHEN k > 0 THEN dt END) AS DOUBLE) END AS mean FROM r GROUP BY user_id")
def interval_concurrency(spark, sf_dir):
    return intervals.concurrency(_spans(spark, sf_dir, 86_400), "user_id")


@query(
    "WITH s AS (SELECT user_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events), x AS (SELECT user_id, t AS a, t + 86400 AS b FROM s WHERE event_id < (SELECT count(*) // 2 FROM events)), y AS (SELECT user_id, t AS a, t + 172800 AS b FROM s WHERE event_id >= (SELECT count(*) // 2 FROM events))"
    + _MERGED.format("x", "x") + _MERGED.format("y", "y")
    + " SELECT mx.user_id, CAST(sum(least(mx.b, my.b) - greatest(mx.a, my.a)) AS BIGINT) AS shared FROM mx JOIN my ON mx.user_id = my.user_id AND mx.a < my.b AND my.a < mx.b GROUP BY mx.user_id"
)
def interval_overlap(spark, sf_dir):
    """Overlap of the first half's intervals with those of the second half."""
    path = events(spark, sf_dir)
    n = api.list_datasets(spark, path).where("path = '/events/value'").first().shape[0]
    spans = _spans(spark, sf_dir, 0, keep=("i0",))
    first = spans.where(F.col("i0") < n // 2).select("user_id", "start", (F.col("start") + 86_400).alias("end"))
    second = spans.where(F.col("i0") >= n // 2).select("user_id", "start", (F.col("start") + 172_800).alias("end"))
    return intervals.overlap(first, second, "user_id", 1 << 20)


# array axes


@query("SELECT event_id AS i0, user_id, value FROM events")
def column_assembly(spark, sf_dir):
    path = events(spark, sf_dir)
    return arrays.assemble({c: api.read(spark, path, dataset=f"/events/{c}") for c in ("user_id", "value")})


@query("SELECT event_id // 100 AS bucket, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def resample_mean(spark, sf_dir):
    data = api.read(spark, events(spark, sf_dir), dataset="/events/value")
    return arrays.resample(data, 100, F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT event_id AS i0, CAST(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolled FROM events")
def rolling_sum(spark, sf_dir):
    data = api.read(spark, events(spark, sf_dir), dataset="/events/user_id")
    return arrays.rolling(data, F.sum("value"), "rolled", 4, block=512).select("i0", "rolled")


@query("SELECT event_id AS i0, value FROM events ORDER BY event_id LIMIT 10")
def topk_head10(spark, sf_dir):
    return arrays.head(api.read(spark, events(spark, sf_dir), dataset="/events/value"))


@query("SELECT part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM (SELECT o_custkey, 'part' || (o_orderkey % 3) AS part FROM orders) GROUP BY part")
def many_files(spark, sf_dir):
    """The same dataset of every file in a folder."""
    folder = f"{home(spark)}/{os.path.basename(staged(spark, sf_dir, 'marker', Writer))}-parts"
    if not os.path.isdir(folder):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        os.makedirs(folder + ".tmp", exist_ok=True)
        for k in range(3):
            save(Writer(k % 2 == 1), f"{folder}.tmp/part{k}.h5", orders.where(F.col("o_orderkey") % 3 == k), "o_orderkey", {"/custkey": Spread("o_custkey", "i8", {"chunk": (700,), "deflate": 1})})
        os.rename(folder + ".tmp", folder)
    data = api.read(spark, folder, dataset="/custkey", file_column=True)
    return data.groupBy(F.regexp_extract("file", r"(part\d)\.h5$", 1).alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("keys"))


# relational operators after the scan: Catalyst's own, one query each


def _after(name: str, sql: str, spark_sql: str | None = None) -> None:
    def f(spark, sf_dir):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        arrays.assemble({"user_id": api.read(spark, events(spark, sf_dir), dataset="/events/user_id"), "value": api.read(spark, events(spark, sf_dir), dataset="/events/value")}).createOrReplaceTempView("ev")
        return spark.sql(spark_sql or sql)

    query(re.sub(r"FROM ev\b", "FROM (SELECT event_id AS i0, user_id, value FROM events) AS ev", sql), name)(f)


_after("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_after("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_after("join_full", "SELECT count(*) AS n, count(c_custkey) AS c, count(o_orderkey) AS o FROM customer FULL JOIN orders ON o_custkey = c_custkey")
_after("join_range", "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey >= r.r_regionkey * 5 AND n.n_nationkey < r.r_regionkey * 5 + 5 GROUP BY r.r_name")
_after("aggregate_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
_after("aggregate_rollup", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_after("aggregate_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_after("window_rank", "SELECT i0, user_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC, i0) AS BIGINT) AS place, lag(i0) OVER (PARTITION BY user_id ORDER BY i0) AS previous FROM ev")
_after("sort_limit_offset", "SELECT i0, value FROM ev ORDER BY value DESC, i0 LIMIT 20 OFFSET 5")
_after("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
_after("join_semi", "SELECT i0 FROM ev WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_nationkey < 10)")
_after("join_anti", "SELECT i0 FROM ev WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_nationkey < 10)")
_after("join_right", "SELECT c_custkey, count(i0) AS n FROM ev RIGHT JOIN customer ON c_custkey = user_id GROUP BY c_custkey")
_after("join_merge", "SELECT c_nationkey, count(*) AS n FROM ev JOIN customer ON c_custkey = user_id GROUP BY c_nationkey", "SELECT /*+ MERGE(customer) */ c_nationkey, count(*) AS n FROM ev JOIN customer ON c_custkey = user_id GROUP BY c_nationkey")
_after("join_shuffled_hash", "SELECT c_mktsegment, count(*) AS n FROM ev JOIN customer ON c_custkey = user_id GROUP BY c_mktsegment", "SELECT /*+ SHUFFLE_HASH(customer) */ c_mktsegment, count(*) AS n FROM ev JOIN customer ON c_custkey = user_id GROUP BY c_mktsegment")
_after("set_intersect", "SELECT user_id AS k FROM ev WHERE value > 300 INTERSECT SELECT user_id AS k FROM ev WHERE value < 1")
_after("set_intersect_all", "SELECT user_id AS k FROM ev WHERE value > 100 INTERSECT ALL SELECT user_id AS k FROM ev WHERE value < 5")
_after("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id AS k FROM ev WHERE value > 200")
_after("approx_distinct", "SELECT count(DISTINCT user_id) AS users, true AS near FROM ev", "SELECT count(DISTINCT user_id) AS users, abs(approx_count_distinct(user_id, 0.02) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM ev")
_after("approx_quantile", "SELECT user_id, count(*) AS n, true AS inside FROM ev GROUP BY user_id", "SELECT user_id, count(*) AS n, approx_percentile(value, 0.5, 1000) BETWEEN percentile(value, 0.45) AND percentile(value, 0.55) AS inside FROM ev GROUP BY user_id")
_after("functions_mixed", "SELECT n_nationkey, upper(n_name) AS big, CAST(length(n_name) AS BIGINT) AS n, substr(n_name, 1, 3) AS head, regexp_replace(n_name, '[AEIOU]', '-', 'g') AS masked, regexp_extract(n_name, '([A-Z])[A-Z]*$', 1) AS tail FROM nation", "SELECT n_nationkey, upper(n_name) AS big, CAST(length(n_name) AS BIGINT) AS n, substr(n_name, 1, 3) AS head, regexp_replace(n_name, '[AEIOU]', '-') AS masked, regexp_extract(n_name, '([A-Z])[A-Z]*$', 1) AS tail FROM nation")
_after("functions_math", "SELECT i0, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log, user_id % 7 AS rest, CAST(sign(value - 50) AS INT) AS side FROM ev", "SELECT i0, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log, user_id % 7 AS rest, CAST(sign(value - 50) AS INT) AS side FROM ev")
_after("functions_dates", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS since, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS later FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, datediff(ts, DATE '2024-01-01') AS since, add_months(CAST(ts AS DATE), 1) AS later FROM events")
_after(
    "functions_nested",
    "SELECT user_id, CAST(len(list(value)) AS BIGINT) AS n, list_max(list(value)) AS high, CAST(len(list_filter(list(value), lambda x: x > 50)) AS BIGINT) AS above, CAST(json_extract_string(json_object('u', user_id), '$.u') AS BIGINT) AS json, CAST(cardinality(map_from_entries(list(DISTINCT (i0 % 5, i0 % 5)))) AS BIGINT) AS keys FROM ev GROUP BY user_id",
    "SELECT user_id, CAST(size(collect_list(value)) AS BIGINT) AS n, array_max(collect_list(value)) AS high, CAST(size(filter(collect_list(value), x -> x > 50)) AS BIGINT) AS above, CAST(get_json_object(to_json(named_struct('u', user_id)), '$.u') AS BIGINT) AS json, CAST(cardinality(map_from_entries(collect_set(struct(i0 % 5, i0 % 5)))) AS BIGINT) AS keys FROM ev GROUP BY user_id",
)
_after("pivot_counts", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders GROUP BY o_orderpriority")


_after("join_cross", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a CROSS JOIN region b")
_after("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
_after("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region")
_after("aggregate_percentile", "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS high FROM ev GROUP BY user_id", "SELECT user_id, round(percentile(value, 0.5), 6) AS median, round(percentile(value, 0.9), 6) AS high FROM ev GROUP BY user_id")
_after("window_range_frame", "SELECT i0, user_id, count(*) OVER (PARTITION BY user_id ORDER BY i0 RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM ev")
_after(
    "session_windows",
    "SELECT user_id, count(*) AS n, min(ts) AS first FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g",
    "SELECT user_id, count(*) AS n, min(ts) AS first FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events) GROUP BY user_id, session_window(ts, '1 hour')",
)


@query("SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")
def grouped_python_aggregate(spark, sf_dir):
    """A grouped aggregate of one's own, in Arrow batches."""
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    path = events(spark, sf_dir)
    both = arrays.assemble({c: api.read(spark, path, dataset=f"/events/{c}") for c in ("user_id", "value")})
    return both.groupBy("user_id").agg(F.round(spread("value"), 6).alias("spread"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """A stream over the events file, drained; complete mode, so every window is in the result."""
    import tempfile

    from .streaming.arrivals import tumbling

    folder = tempfile.mkdtemp(dir=home(spark))
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    name = f"tumbling_{os.path.basename(folder)}".replace("-", "_")
    q = tumbling(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").alias("start"), "n")


@query("SELECT '/' || t AS path, n AS elements FROM (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation)")
def stream_arrivals(spark, sf_dir):
    """Catalog rows of files as they arrive in a folder."""
    import tempfile

    from .streaming.arrivals import catalog_stream, drain

    folder = tempfile.mkdtemp(dir=home(spark))
    for t, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        w = Writer()
        w.dataset(f"/{t}", column(spark, sf_dir, t, key)[key].to_numpy())
        w.save(f"{folder}/{t}.h5")
    drain(catalog_stream(spark, folder), f"{folder}/out", f"{folder}/c")
    return spark.read.parquet(f"{folder}/out").select("path", "elements")


@query("SELECT l.event_id AS i0, l.user_id, r.event_id AS seen_i0, r.value AS seen FROM (SELECT * FROM events WHERE event_id % 3 = 0) AS l ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 1) AS r ON l.user_id = r.user_id AND l.event_id >= r.event_id")
def asof_join(spark, sf_dir):
    """For each third element the latest element of the next kind before it, by user."""
    ev = arrays.assemble({c: api.read(spark, events(spark, sf_dir), dataset=f"/events/{c}") for c in ("user_id", "value")})
    seen = ev.where("i0 % 3 = 1").select("user_id", "i0", F.col("i0").alias("seen_i0"), F.col("value").alias("seen"))
    return arrays.asof(ev.where("i0 % 3 = 0").select("i0", "user_id"), seen, "user_id", "i0")


@query("""
WITH RECURSIVE o(path, parent) AS (VALUES ('/customer', '/'), ('/customer/balance', '/customer'), ('/customer/key', '/customer'), ('/many', '/'), ('/nation', '/'), ('/nation/name', '/nation')),
t AS (SELECT path, 1 AS depth, path AS top FROM o WHERE parent = '/' UNION ALL SELECT o.path, depth + 1, top FROM t JOIN o ON o.parent = t.path)
SELECT path, depth, top FROM t
""")
def recursive_traversal(spark, sf_dir):
    """The group tree of a file, walked from the root by a recursive query."""
    api.list_objects(spark, tables(spark, sf_dir)).createOrReplaceTempView("objects_of_file")
    return spark.sql("WITH RECURSIVE t AS (SELECT path, 1 AS depth, path AS top FROM objects_of_file WHERE parent = '/' UNION ALL SELECT o.path, depth + 1, top FROM t JOIN objects_of_file o ON o.parent = t.path) SELECT path, depth, top FROM t")


@query("SELECT (SELECT count(*) FROM region) || ',' || (SELECT count(*) FROM nation) || ',' || (SELECT count(*) FROM customer) AS sizes, 'by hand' AS created, 'by hand' AS strs, true AS no_ints, true AS missing, 'balance,key' AS children")
def attribute_values(spark, sf_dir):
    """Attributes by name, as integers, a string and strings, and the children of an object."""
    path = tables(spark, sf_dir)
    created, sizes = api.attr(spark, path, "created"), api.attr(spark, path, "sizes")
    row = (",".join(map(str, sizes.as_ints())), created.as_str(), ",".join(created.as_strs()), created.as_ints() is None, api.attr(spark, path, "none of them") is None)
    found = spark.createDataFrame([row], "sizes string, created string, strs string, no_ints boolean, missing boolean")
    names = api.open_object(spark, path, "customer").select(F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))
    return found.join(names)


@query("SELECT * FROM (VALUES ('backwards', 'InvalidSelection'), ('rank', 'InvalidSelection'), ('type', 'TypeMismatch'), ('missing', 'InvalidSelection'), ('store', 'Store')) AS t(attempt, kind)")
def error_kinds(spark, sf_dir):
    """The kinds of error that wrong reads raise."""
    from .errors import EngineError

    path = events(spark, sf_dir)
    attempts = {
        "backwards": lambda: ArrayReader("array", {"dataset": "/events/value", "selection": "9:3"}, [path]).partitions(),
        "rank": lambda: ArrayReader("array", {"dataset": "/events/value", "selection": "0:3,0:3"}, [path]).partitions(),
        "type": lambda: ArrayReader("array", {"dataset": "/events/value", "dtype": "i32"}, [path]).partitions(),
        "missing": lambda: ArrayReader("array", {"dataset": "/events/none"}, [path]).partitions(),
        "store": lambda: ArrayReader("array", {"dataset": "/events/value"}, [path + ".gone"]).partitions(),
    }
    out = []
    for name, attempt in attempts.items():
        try:
            attempt()
        except EngineError as e:
            out.append((name, e.kind))
    return spark.createDataFrame(out, "attempt string, kind string")


@query("SELECT 4 AS ranges, true AS in_order, true AS streamed, true AS one_batch")
def byte_ranges(spark, sf_dir):
    """Ranges of a file's bytes in the order asked for, in one batch, and the same bytes as a stream."""
    from .sources.bytesource import ByteSource, ReadOptions

    source = ByteSource.open(events(spark, sf_dir), ReadOptions())
    ranges = [(100, 200), (0, 8), (150, 160), (512, 4096)]
    whole = source.get_range(0, 4096)
    before = source.stats.batches
    found = source.read_ranges(ranges)
    batches = source.stats.batches - before
    row = (len(found), found == [whole[a:b] for a, b in ranges], b"".join(source.stream(0, 4096, 1000)) == whole, batches == 1)
    source.close()
    return spark.createDataFrame([row], "ranges int, in_order boolean, streamed boolean, one_batch boolean")


def _arrivals(spark, sf_dir, *parts: str):
    """A stream of event rows: one file, and so one batch, for each condition; the files arrive in that order."""
    import tempfile

    folder = tempfile.mkdtemp(dir=home(spark))
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, part in enumerate(parts):
        spark_rows = source.selectExpr("event_id", part, "user_id", "event_type", "value") if " AS ts" in part else source.where(part).select("event_id", "ts", "user_id", "event_type", "value")
        (spark_rows.limit(1) if " AS ts" in part else spark_rows).coalesce(1).write.parquet(f"{folder}/{i}")
        for f in sorted(os.listdir(f"{folder}/{i}")):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.replace(f"{folder}/{i}/{f}", f"{folder}/in/{i}.parquet")
                os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def stream_sliding(spark, sf_dir):
    """Windows of two hours every hour over a stream, in append mode; a row that comes far too late is dropped, a last row closes the windows."""
    from .streaming.arrivals import drain, sliding

    stream, folder = _arrivals(spark, sf_dir, "event_id % 2 = 0", "event_id % 2 = 1", "TIMESTAMP'2000-01-01 00:00:00' AS ts", "TIMESTAMP'2100-01-01 00:00:00' AS ts")
    drain(sliding(stream), f"{folder}/out", f"{folder}/c")
    return spark.read.parquet(f"{folder}/out").select(F.col("window.start").alias("start"), "n")


@query("SELECT user_id, count(*) AS n, max(value) AS high FROM events GROUP BY user_id")
def stream_stateful(spark, sf_dir):
    """Running counts and maxima by user, kept as state over the batches of a stream."""
    from .streaming.arrivals import running

    stream, folder = _arrivals(spark, sf_dir, "event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2")
    name = f"running_{folder.rsplit('/', 1)[-1]}".replace("-", "_")
    q = running(stream, "user_id", "value").writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).groupBy("user_id").agg(F.max("n").alias("n"), F.max("high").alias("high"))
