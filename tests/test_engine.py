"""The data source, the operators and the queries on Spark, against SQL and brute force."""

import collections

import numpy as np
import pytest

import __spark_entry__ as entry
from chunkwell import api
from chunkwell import queries as engine
from chunkwell.fixtures.h5writer import UNLIMITED, Vl, Writer
from chunkwell.operators import arrays, intervals
from chunkwell.plans.selection import bounds
from chunkwell.sources.bytesource import merge_ranges

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_queries(spark, sf, db, name):
    df = engine.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = db.sql(engine.SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(engine.QUERIES.keys() - engine.SQL.keys()))
def test_queries_without_sql(spark, sf, name):
    assert engine.QUERIES[name](spark, sf).count() > 0


def test_chunk_prune_count_of_many_vectors(spark, tmp_path):
    """More vectors than the first 10,000: the last selection box still covers them all, as in the SQL."""
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE TABLE embeddings AS SELECT i AS vec_id, list_transform(range(0, 64), lambda k: CAST(k AS FLOAT)) AS embedding FROM range(0, 10300) AS t(i)")
    c.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    want = {tuple(r) for r in c.sql(engine.SQL["chunk_prune_count"]).fetchall()}
    assert {(r.id, r.chunks) for r in engine.QUERIES["chunk_prune_count"](spark, str(tmp_path)).collect()} == want


def file(tmp_path, latest=False, **datasets):
    w = Writer(latest)
    for name, (data, options) in datasets.items():
        w.dataset(f"/{name}", data, **options)
    return w.save(f"{tmp_path}/f.h5")


def test_where_reads_only_what_it_needs(spark, tmp_path):
    api.register(spark)
    path = file(tmp_path, x=(np.arange(10_000, dtype="i4"), {"chunk": (100,)}))
    df = api.where(spark, path, "x", "i0 >= 250 AND i0 < 470 AND value % 2 = 0", partition_bytes=1)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r.value for r in df.collect()) == list(range(250, 470, 2))
    assert api.where(spark, path, "x", "i0 < 0").count() == 0 and api.where(spark, path, "x", "i0 = 7 OR i0 = 9999").count() == 2


def test_pushdown(spark, tmp_path):
    api.register(spark)
    path = file(tmp_path, x=(np.arange(1000, dtype="i4"), {"chunk": (10,)}))
    one = api.read(spark, path, dataset="x", pushdown=True, partition_bytes=1).where("i0 >= 25 AND i0 < 47")
    assert one.rdd.getNumPartitions() == 3
    assert one.count() == 22
    # without it, one DataFrame may be used with many filters
    df = api.read(spark, path, dataset="x")
    assert df.where("i0 < 10").union(df.where("i0 >= 10")).count() == 1000 and df.count() == 1000


def test_bounds():
    assert bounds("i0 >= 5 and I0 < 9 AND value > 3") == {0: (5, 9)}
    assert bounds("i1 IN (4, 7) AND i0=3 AND i0<=8") == {1: (4, 8), 0: (3, 4)}
    assert bounds("i0 > 3 OR i0 = 1") == bounds("i0 BETWEEN 1 AND 3") == bounds("NOT i0 = 3") == bounds("value = 'i0 > 3 and i0 < 5'") == {}
    assert bounds("(i0 > 3 or i0 < 1) and i0 < 9") == {0: (0, 9)} and bounds("i0 < 3 and i0 > 7") == {0: (8, 8)}


@pytest.mark.parametrize("latest", [False, True])
def test_modes(spark, tmp_path, latest):
    api.register(spark)
    data = np.arange(7 * 11 * 5, dtype="f4").reshape(7, 11, 5)
    path = file(tmp_path, latest, x=(data, {"chunk": (3, 4, 2), "deflate": 1}), s=(Vl(["a", "", "ü"]), {}), n=(np.float64(4.5), {}))
    assert np.array_equal(api.to_numpy(api.read_full(spark, path, "x", "f32"), 3), data)
    assert np.array_equal(api.to_numpy(api.read_range(spark, path, "x", [(2, 5), (3, 30), (1, 4)]).selectExpr("i0 - 2 AS i0", "i1 - 3 AS i1", "i2 - 1 AS i2", "value"), 3), data[2:5, 3:30, 1:4])
    rows = {(r.i0, r.i1): r["values"] for r in api.read(spark, path, "rows", dataset="x", selection="1:6,:,1:4").collect()}
    assert rows == {(i, j): data[i, j, 1:4].tolist() for i in range(1, 6) for j in range(11)}
    raw = api.read_range_bytes(spark, path, "x", [(0, 1), (0, 1), (0, 5)]).orderBy("i2").collect()
    assert [np.frombuffer(bytes(r.value), "f4")[0] for r in raw] == data[0, 0].tolist()
    assert [r.value for r in api.read_strings(spark, path, "s").orderBy("i0").collect()] == ["a", "", "ü"] and api.read_strings(spark, path, "x") is None
    assert api.read_full(spark, path, "n").collect()[0].value == 4.5
    assert api.open_dataset(spark, path, "x").count() == data.size and api.open_dataset(spark, path, "no") is None and api.open_object(spark, path, "no") is None
    assert [r.name for r in api.open_object(spark, path).collect()[0].children] == ["n", "s", "x"]
    assert api.read(spark, path, dataset="x", coords=False).columns == ["value"]
    stats = api.io_stats(spark, path, "x").collect()
    assert sum(r.requests for r in stats) >= 1 and sum(r.bytes for r in stats) > 0


def test_attr(spark, tmp_path):
    w = Writer()
    w.dataset("/x", np.arange(3), {"n": np.array([1, 2], "i4"), "s": Vl(["one"])})
    path = w.save(f"{tmp_path}/f.h5")
    assert api.attr(spark, path, "n", "x").as_ints() == [1, 2] and api.attr(spark, path, "s", "x").as_str() == "one"
    assert api.attr(spark, path, "no", "x") is None and api.attr(spark, path, "n", "nowhere") is None


def test_errors_name_their_kind(spark, tmp_path):
    api.register(spark)
    path = file(tmp_path, x=(np.arange(10, dtype="u4"), {}), z=(np.arange(10, dtype="u4"), {"chunk": (5,), "filters": [(32015, (1,))]}))
    for kind, run in {
        "TypeMismatch": lambda: api.read_full(spark, path, "x", "f64"),
        "InvalidSelection": lambda: api.read_range(spark, path, "x", [(0, 1), (0, 1)]).count(),
        "Unsupported": lambda: api.read_full(spark, path, "z"),
        "Store": lambda: api.list_datasets(spark, f"{tmp_path}/none.h5").count(),
    }.items():
        with pytest.raises(Exception, match=kind):
            run()


def test_many_partitions_of_a_resizable_array(spark, tmp_path):
    api.register(spark)
    data = np.arange(200_000, dtype="i8")
    path = file(tmp_path, True, x=(data, {"chunk": (1000,), "max_dims": (UNLIMITED,), "shuffle": True, "deflate": 1}))
    df = api.read(spark, path, dataset="x", partition_bytes=5_000)
    assert df.rdd.getNumPartitions() > 5
    r = df.selectExpr("count(*) AS n", "sum(value) AS s", "sum(i0 - value) AS d").first()
    assert (r.n, r.s, r.d) == (len(data), int(data.sum()), 0)


def test_rolling_at_block_ends(spark):
    n = 300
    df = spark.range(n).selectExpr("id AS i0", "id * id AS value")
    from pyspark.sql import functions as F

    for block in (7, 50, 1000):
        got = {r.i0: r.s for r in arrays.rolling(df, F.sum("value"), "s", 6, block=block).collect()}
        assert got == {i: sum(j * j for j in range(max(0, i - 6), i + 1)) for i in range(n)}


def spans(seed=2, n=400):
    rng = np.random.default_rng(seed)
    out = [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 4, n), rng.integers(0, 3000, n), rng.integers(0, 40, n), strict=True)]
    return [*out, (9, 5, 5), (8, 0, 10), (8, 10, 20)]


@pytest.mark.parametrize("bucket", [16, 1 << 16])
def test_intervals(spark, bucket):
    data = spans()
    df = spark.createDataFrame(data, "k long, start long, end long")
    sets = collections.defaultdict(set)
    for k, a, b in data:
        sets[k] |= set(range(a, b))
    merged = intervals.merged(df, "k", bucket=bucket).collect()
    for k in {k for k, _, _ in data}:
        own = sorted((r.start, r.end) for r in merged if r.k == k)
        assert set().union(*(range(a, b) for a, b in own)) == sets[k] and all(own[i][1] < own[i + 1][0] for i in range(len(own) - 1))
    assert {r.k: r.covered for r in intervals.union_length(df, "k").collect()} == {k: len(v) for k, v in sets.items() if v}
    other = spark.createDataFrame([(k, a + 17, b + 17) for k, a, b in data], "k long, start long, end long")
    want = {k: len(v & {x + 17 for x in v}) for k, v in sets.items()}
    assert {r.k: r.shared for r in intervals.overlap(df, other, "k", bucket).collect()} == {k: n for k, n in want.items() if n}
    peak = {r.k: (r.peak, r.busy) for r in intervals.concurrency(df, "k").collect()}
    for k, v in sets.items():
        own = [(a, b) for x, a, b in data if x == k]
        assert peak[k] == (max(sum(a <= t <= b for a, b in own) for t in {t for s in own for t in s}), len(v))


def test_ranges_as_reads_are_grouped(spark):
    data = spans(5)
    got = collections.Counter(tuple(r) for r in intervals.coalesce_ranges(spark.createDataFrame(data, "k long, start long, end long"), "k", 3, 50).collect())
    want = collections.Counter()
    for k in {k for k, _, _ in data}:
        want.update((k, a, b) for a, b in merge_ranges([(a, b) for x, a, b in data if x == k], 3, 50))
    assert got == want


def test_chunk_arithmetic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(5, [3, 4], [10, 7])], "i long, grid array<long>, chunk array<long>")
    r = df.select(arrays.offsets_for_index(F.col("i"), F.col("grid"), F.col("chunk")).alias("o"), arrays.num_elements(F.col("grid")).alias("n"), arrays.chunk_counts(F.array(F.lit(10), F.lit(9)), F.array(F.lit(3), F.lit(4))).alias("c")).first()
    assert (r.o, r.n, r.c) == ([10, 7], 12, [4, 3])
    flat = spark.createDataFrame([(1, 2)], "i0 long, i1 long").select(arrays.position([4, 5]).alias("p")).first()
    assert flat.p == 7


def test_decode_columns(spark):
    import zlib

    from pyspark.sql import functions as F

    from chunkwell.functions import decode

    df = spark.createDataFrame([(zlib.compress(b"acbd"), 2), (None, 1)], "b binary, mask long")
    got = df.select(decode.unshuffle_column(decode.inflate_column(F.col("b")), 2).alias("x"), decode.filter_applies(F.col("mask"), 1).alias("f")).collect()
    assert [r.x and bytes(r.x) for r in got] == [b"abcd", None] and [r.f for r in got] == [False, True]


@pytest.mark.parametrize("latest", [False, True])
def test_read_with_spark(spark, tmp_path, latest):
    api.register(spark)
    data = np.arange(600, dtype="i2").reshape(20, 30)
    path = file(tmp_path, latest, x=(data, {"chunk": (7, 8), "deflate": 1}))
    assert np.array_equal(api.to_numpy(api.read_with_spark(spark, f"file://{path}", "array", dataset="x"), 2), data)
    assert [r.path for r in api.read_with_spark(spark, f"file://{path}").collect()] == ["/x"]


def test_http_store(spark, tmp_path):
    import http.server
    import threading

    class Ranges(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            whole = open(path, "rb").read()
            a, b = self.headers["Range"].removeprefix("bytes=").split("-")
            part = whole[int(a) : int(b) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{int(a) + len(part) - 1}/{len(whole)}")
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    data = np.arange(50_000, dtype="f8")
    path = file(tmp_path, x=(data, {"chunk": (1000,), "deflate": 1}))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/f.h5"
        api.register(spark)
        assert np.array_equal(api.to_numpy(api.read(spark, url, dataset="x", max_span=4096), 1), data)
        assert api.where(spark, url, "x", "i0 < 10").count() == 10
    finally:
        server.shutdown()


def test_remote_files(tmp_path):
    from pyarrow import fs

    from chunkwell.sources.hdf5 import remote_files

    for name in ("a.h5", "b.hdf5", "c.txt", "sub/d.h5"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    here = (fs.LocalFileSystem(), str(tmp_path))
    assert remote_files("store://bucket/x/", here) == ["store://bucket/x/a.h5", "store://bucket/x/b.hdf5"]
    assert remote_files("store://bucket/x/*.h5", here) == ["store://bucket/x/a.h5"]
    assert remote_files("store://bucket/x/*/?.h5", here) == ["store://bucket/x/sub/d.h5"]
    assert remote_files("store://bucket/x/a.h5", (fs.LocalFileSystem(), str(tmp_path / "a.h5"))) == ["store://bucket/x/a.h5"]
    assert remote_files("https://host/x/*.h5") == ["https://host/x/*.h5"]


def test_small_chunks_share_batches(tmp_path):
    from chunkwell.sources.hdf5 import ArrayReader

    data = np.arange(30_000, dtype="i4").reshape(300, 100)
    w = Writer(True)
    w.dataset("/x", data, chunk=(3, 4))
    reader = ArrayReader("array", {"dataset": "/x", "parallelism": "1"}, [w.save(str(tmp_path / "x.h5"))])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) <= 2 * len(reader.partitions())
    got = np.zeros_like(data)
    for b in batches:
        got[b.column("i0").to_numpy(), b.column("i1").to_numpy()] = b.column("value").to_numpy()
    assert (got == data).all()


def test_missing_cells_plan_as_runs():
    """10^9 missing cells are planned at once; the runs and the stored cells cover the grid once."""
    import time

    from chunkwell.plans import planner
    from chunkwell.sources.bytesource import ReadOptions

    class Sparse:
        class layout:
            kind, chunk = "Chunked", (2, 2)

        class space:
            kind = "simple"

        class dtype:
            element_size = 1

        def __init__(self, shape, stored):
            self.shape, self.ndim = shape, 2
            self.chunks = [planner.Chunk(at, 1000 + i, 4, 0) for i, at in enumerate(stored)]

    began = time.perf_counter()
    n = 63_246
    groups = planner.pieces(Sparse((n, n), [(0, 0), (2 * 20_000, 4)]), ((0, n), (0, n)), ReadOptions())
    holes = [p for g in groups for p in g if isinstance(p, planner.Holes)]
    assert time.perf_counter() - began < 2 and len(holes) < 10_000
    assert sum(planner.selection.volume(h.cells) - len(h.stored) for h in holes) == (n // 2) ** 2 - 2
    box, seen = ((3, 21), (1, 30)), np.zeros((40, 40), int)
    for g in planner.pieces(Sparse((40, 40), [(4, 4), (20, 28), (38, 38)]), box, ReadOptions()):
        for p in planner.expanded(g):
            seen[tuple(slice(a, z) for a, z in p.box)] += 1
    assert (seen[3:21, 1:30] == 1).all() and seen.sum() == 18 * 29


def test_asof_join(spark):
    from chunkwell.operators import arrays

    rng = np.random.default_rng(2)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 50, 60), strict=True))]
    right = list({(int(k), int(t)): (int(k), int(t), float(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 30), rng.integers(0, 50, 30), strict=True))}.values())
    got = arrays.asof(spark.createDataFrame(left, "k long, t long, n long"), spark.createDataFrame(right, "k long, t long, v double"), "k", "t")
    want = {n: max(((u, v) for j, u, v in right if j == k and u <= t), default=(0, None))[1] for k, t, n in left}
    assert {r.n: r.v for r in got.collect()} == want and got.count() == 60
