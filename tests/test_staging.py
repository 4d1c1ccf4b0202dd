"""Staging by tasks: the same files as by the driver, and no rows on the driver."""

import glob

import numpy as np
import pytest

from chunkwell import api
from chunkwell import queries as engine
from chunkwell.fixtures import spread
from chunkwell.fixtures.h5writer import UNLIMITED, Enum, Fixed, Vl, Writer, checked, checked_rows
from chunkwell.fixtures.spread import Spread


@pytest.fixture(autouse=True)
def registered(spark):
    api.register(spark)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(spread, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(spread, "TEXT_ROWS", 64)
    monkeypatch.setattr(spread, "RANGE_ROWS", 100)


def table(spark, n=1000):
    """Shuffled rows with keys that have gaps."""
    return spark.range(n).selectExpr("id * 3 + id % 2 AS k", "id * 7 % 1001 AS v", "repeat(chr(CAST(97 + id % 26 AS INT)), CAST(id % 11 AS INT)) AS s", "CAST(id % 5 = 0 AS INT) AS e", "transform(sequence(0, 9), x -> CAST(id + x AS FLOAT)) AS l").repartition(5, "v")


def values(df, *index):
    return [r.value for r in df.orderBy(*(index or ("i0",))).collect()]


def test_checksums_of_rows():
    rng = np.random.default_rng(0)
    for length in (0, 1, 11, 12, 13, 24, 100):
        rows = rng.integers(0, 256, (5, length), "u1")
        assert [bytes(r) for r in checked_rows(rows)] == [checked(bytes(r)) for r in rows]


@pytest.mark.parametrize("latest,options", [
    (False, {"chunk": (50,), "shuffle": True, "deflate": 1}),
    (True, {"chunk": (7,), "index": "implicit"}),
    (True, {"chunk": (3,), "max_dims": (UNLIMITED,), "page_bits": 5}),
    (True, {"chunk": (10,), "shuffle": True, "deflate": 1, "masks": {0: 3, 2: 1, 5: 2}}),
    (True, {}),
])
def test_numbers_by_tasks(spark, tmp_path, small_blocks, latest, options):
    spread.save(Writer(latest), f"{tmp_path}/a.h5", table(spark), "k", {"/d": Spread("v", "i8", options), "/more": Spread("e", Enum(np.zeros(0, "u1")), {"chunk": (9,), "deflate": 1})})
    want = [r.v for r in table(spark).orderBy("k").collect()]
    assert values(api.read(spark, f"{tmp_path}/a.h5", dataset="/d")) == want
    assert values(api.read(spark, f"{tmp_path}/a.h5", dataset="/more")) == [r.e for r in table(spark).orderBy("k").collect()]
    if options:
        w = Writer(latest)
        w.dataset("/d", np.array(want), **options)
        w.save(f"{tmp_path}/b.h5")
        sizes = [[(r.chunk_no, r.stored_bytes, r.filter_mask) for r in api.list_chunks(spark, f"{tmp_path}/{f}.h5", dataset="/d").orderBy("chunk_no").collect()] for f in "ab"]
        assert sizes[0] == sizes[1]


def test_missing_chunks_texts_and_vectors_by_tasks(spark, tmp_path, small_blocks):
    rows = table(spark).orderBy("k").collect()
    path = f"{tmp_path}/a.h5"
    spread.save(Writer(True), path, table(spark), "k", {
        "/gaps": Spread("v", "f8", {"chunk": (25,), "missing": {0, 4, 39}}),
        "/fixed": Spread("s", Fixed([], 8, 1), {"chunk": (20,), "deflate": 1}),
        "/text": Spread("s", Vl([]), {"chunk": (16,)}),
        "/rows": Spread("l", "f4", {"chunk": (10, 4), "max_dims": (UNLIMITED, UNLIMITED), "deflate": 1}, inner=10),
    })
    assert values(api.read(spark, path, dataset="/gaps")) == [0.0 if i // 25 in (0, 4, 39) else r.v for i, r in enumerate(rows)]
    assert values(api.read_strings(spark, path, "/fixed")) == [r.s[:8] for r in rows]
    assert values(api.read_strings(spark, path, "/text")) == [r.s for r in rows]
    assert values(api.read(spark, path, dataset="/rows"), "i0", "i1") == [x for r in rows for x in r.l]
    spread.save(Writer(True), f"{tmp_path}/b.h5", table(spark).where("v > 900"), "k", {"/sparse": Spread("v", "i4", {"chunk": (16,), "skip_zero": True})}, by_key=True)
    whole = np.zeros(max(r.k for r in rows if r.v > 900) + 1, "i4")
    for r in rows:
        if r.v > 900:
            whole[r.k] = r.v
    assert values(api.read(spark, f"{tmp_path}/b.h5", dataset="/sparse")) == whole.tolist()
    assert api.list_chunks(spark, f"{tmp_path}/b.h5", dataset="/sparse").count() == sum(whole[i : i + 16].any() for i in range(0, len(whole), 16))


def test_an_empty_table_by_tasks(spark, tmp_path):
    spread.save(Writer(True), f"{tmp_path}/a.h5", table(spark, 0), "k", {"/d": Spread("v", "i8", {"chunk": (5,), "deflate": 1}), "/t": Spread("s", Vl([]), {"chunk": (5,)}), "/c": Spread("v", "f8")})
    assert [api.read(spark, f"{tmp_path}/a.h5", dataset=d).count() for d in ("/d", "/t", "/c")] == [0, 0, 0]


@pytest.mark.parametrize("name", ["strings_fixed", "strings_vl", "vl_heap_join", "index_implicit", "filter_masks", "interval_total", "many_files", "type_u8", "index_tree2", "enum_numbers", "sparse_axis"])
def test_no_rows_on_the_driver(spark, sf, name, monkeypatch, tmp_path):
    """Staging sent whole columns to the driver, which ran out of memory."""
    from pyspark.sql.classic.dataframe import DataFrame

    from chunkwell.fixtures import stage

    def refuse(self):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(stage, "_HOME", [str(tmp_path)])
    monkeypatch.setattr(DataFrame, "toArrow", refuse)
    assert engine.QUERIES[name](spark, sf).count() > 0


def test_single_chunks_hold_the_whole_table(spark, tmp_path):
    """The one chunk held the first million of the events, the rest read as zeros."""
    n = (1 << 20) + 100
    spark.range(n).selectExpr("id AS event_id", "CAST(id + 1 AS DOUBLE) AS value", "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = engine.QUERIES["index_single"](spark, str(tmp_path))
    r = got.selectExpr("count(*) AS n", "count(DISTINCT i0) AS places", "max(i0) AS last", "sum(CASE WHEN value = i0 + 1 THEN 0 ELSE 1 END) AS wrong").first()
    assert (r.n, r.places, r.last, r.wrong) == (n, n, n - 1, 0)
    files = sorted(glob.glob(f"{engine.home(spark)}/*-single-*/part*.h5"))
    assert {r["index"] for r in api.list_datasets(spark, ",".join(files)).collect()} == {"SingleChunk"}  # one chunk in each file


def test_many_small_chunks_are_planned_in_few_bytes():
    """Each chunk was an object on the driver and in its partition, some hundred bytes for 24 of data."""
    import pickle

    from chunkwell.plans import planner
    from chunkwell.sources.bytesource import ReadOptions

    class Small:
        class layout:
            kind, chunk = "Chunked", (3,)

        class space:
            kind = "simple"

        class dtype:
            element_size = 8

        shape, ndim = (600_000,), 1
        chunks = [planner.Chunk((3 * i,), 4096 + 24 * i, 24, 0) for i in range(200_000)]

    groups = planner.pieces(Small(), ((10, 599_990),), ReadOptions())
    assert len(pickle.dumps(groups)) < 100_000
    found = [p for g in groups for p in planner.expanded(g)]
    assert [p.box for p in found] == [((max(10, 3 * i), min(599_990, 3 * i + 3)),) for i in range(3, 199_997)]
    assert [(p.origin, p.address, p.size, p.mask) for p in found] == [((3 * i,), 4096 + 24 * i, 24, 0) for i in range(3, 199_997)]
    assert max(sum(1 for _ in planner.expanded(g)) for g in groups) <= planner.CELLS


def test_repeated_and_scattered_chunks_are_planned_once():
    from chunkwell.fmt.cursor import UNDEFINED
    from chunkwell.plans import planner
    from chunkwell.sources.bytesource import ReadOptions

    class Odd:
        class layout:
            kind, chunk = "Chunked", (2, 2)

        class space:
            kind = "simple"

        class dtype:
            element_size = 1

        shape, ndim = (6, 5), 2
        chunks = [planner.Chunk((4, 4), 900, 4, 0), planner.Chunk((0, 0), 100, 4, 1), planner.Chunk((0, 0), 500, 4, 0), planner.Chunk((2, 2), UNDEFINED, 0, 0), planner.Chunk((2, 0), 10_000_000, 7, 2)]

    groups = planner.pieces(Odd(), ((0, 6), (0, 5)), ReadOptions())
    found = [p for g in groups for p in planner.expanded(g)]
    assert [(p.origin, p.address, p.size, p.mask, p.box) for p in found if p.address != UNDEFINED] == [((0, 0), 100, 4, 1, ((0, 2), (0, 2))), ((4, 4), 900, 4, 0, ((4, 6), (4, 5))), ((2, 0), 10_000_000, 7, 2, ((2, 4), (0, 2)))]
    seen = np.zeros((6, 5), int)
    for p in found:
        seen[tuple(slice(a, z) for a, z in p.box)] += 1
    assert (seen == 1).all()


def test_heap_objects_are_not_broadcast(spark, sf):
    """Their size was taken for that of their addresses, so all texts went to the driver."""
    df = engine.QUERIES["vl_heap_join"](spark, sf)
    assert len(df.collect()) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
