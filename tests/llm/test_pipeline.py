"""The pipeline stage by stage against plain versions of what each stage keeps."""

import collections
import zlib

import corpus_pipeline
import numpy as np
from test_operators import brute_components, brute_contamination, tokenizer

from chunkwell.llm import langid, toxicity


def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def test_stages(spark, sf):
    docs, clean, known, single, pure, packed = stages(spark, sf)
    for df in (clean, known, single, pure):
        assert df.schema == docs.schema
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(pairs(clean)) == sorted((i, t) for i, t in pairs(docs) if model.score(t) < 0.5)
    m = langid.fit(clean)
    assert sorted(pairs(known)) == sorted((i, t) for i, t in pairs(clean) if langid.predict_texts(m, [t])[0][0] != "und")
    comps = brute_components(pairs(known), 5, 80)
    assert sorted(i for i, _ in pairs(single)) == sorted(i for (i, _, c) in comps if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination(pairs(single), items) if r[2]}
    assert bad and sorted(i for i, _ in pairs(pure)) == sorted(i for i, _ in pairs(single) if i not in bad)
    t = tokenizer()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in pairs(pure)}
    spans = collections.defaultdict(list)
    for p in packed.collect():
        x = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) and p.length == len(x)
        spans[p.doc_id].append((p.start, p.length))
    assert spans.keys() == ids.keys()
    for i, parts in spans.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[i])


def test_run_equals_the_stages(spark, sf):
    *_, packed = stages(spark, sf)
    got = corpus_pipeline.run(spark, sf)
    own = lambda df: collections.Counter((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert own(got) == own(packed)


def test_odd_rows(spark, sf):
    """Nulls, empty texts, repeated rows and clashing extra columns pass through the filtering stages."""
    rows = [(1, None, "en", 0), (2, "", None, 0), (3, "plain words that are fine here and there", "en", 1), (3, "plain words that are fine here and there", "en", 1), (None, "a row without an id that says something", "en", 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "0L"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, sf).cache()
        assert df.columns == ["doc_id", "text", "lang", "score"]
    kept = collections.Counter(r.doc_id for r in df.collect())
    assert kept[3] == 1 and kept[None] == 1 and 1 not in kept and 2 not in kept


def test_empty(spark, sf):
    df = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, sf).cache()
        assert df.count() == 0
