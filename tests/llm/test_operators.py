"""The ten operators against brute force, round trips and held-out rows, on small tables."""

import base64
import collections
import hashlib
import json
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from chunkwell.llm import components, decontam, html_text, jaccard_join, langid, license_scan, media, packing, queries, token_counts, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "plain words of text here"), (4, "plain words of text here"), (5, "a<|endoftext|> b <|endoftext|>"),
    (6, "don't  stop\n\n  now 123 ½ ñandú 日本語 🙂‍́ წ5"), (7, "x" * 40_000), (8, "Mit\nLicense, MIT LICENSE mit license"), (None, "row without id"), (9, "힣꟎ ꟎ꟲ"), (10, "word " * 3000),
]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1.0, "y") for i, t in ODD], DOC + ", n_words string, score double, word string")


def rows(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return str(sorted(r.items(), key=lambda x: x[0]))


# 1


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_counts(name, request):
    df = request.getfixturevalue(name)
    t = tokenizer()
    want = []
    for r in df.select("doc_id", "text").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False))
        want.append({"doc_id": r.doc_id, "n_bytes": len((r.text or "").encode()), "n_tokens": n, "over_limit": n > 512})
    got = rows(token_counts.token_counts(df, queries.TOKENIZER, sample_rows=3))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    lengths = token_counts.Lengths(queries.TOKENIZER, {"a": 1})
    for i in range(20):
        assert lengths[f" w{i}"] == len(lengths.encoder.encode(f" w{i}"))
        assert len(lengths) <= 4


# 2


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_media(name, request):
    df = request.getfixturevalue(name)
    for r in media.media_columns(df).join(df.selectExpr("doc_id as d", "text").distinct(), F_eq("doc_id", "d")).collect():
        payload = media.padded((r.text or "").encode())
        stored = media.write_container(payload)
        assert (r.n_bytes, r.payload_bytes) == (len((r.text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        f = json.loads(r.feature)
        assert (f["codec"], f["duration"], f["samples"]) == ("raw ", len(payload), len(payload) // 64)
        assert (r.codec, r.duration) == ("raw ", len(payload) / 8000)
        assert [tuple(x) for x in r.keyframe_ranges] == media.keyframes(media.read_container(stored)[0])
        assert b"".join(stored[x.start : x.end] for x in r.keyframe_ranges) == b"".join(payload[i : i + 64] for i in range(0, len(payload), 512))


def F_eq(a, b):
    from pyspark.sql import functions as F

    return F.col(a).eqNullSafe(F.col(b))


def test_media_reader_takes_other_layouts():
    payload = bytes(range(256)) * 30
    data = media.write_container(payload)
    track = media.read_container(data)[0]
    assert media.read_payload(data, track) == payload
    first = media.keyframes(track)[1]
    assert data[slice(*first)] == payload[8 * 64 : 9 * 64]
    # 64-bit sizes, a box to the end of the file, co64, stz2 with 4-bit sizes, no stss
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 6) + b"abcdef"
    table = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)),
        media.full(b"stz2", struct.pack(">II", 4, 3), bytes([0x12, 0x30])),
        media.full(b"co64", struct.pack(">IQ", 1, 16)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 25, 75, 0, 0))
    moov = struct.pack(">I4s", 0, b"moov") + media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", table)))
    (t,) = media.read_container(mdat + moov)
    assert (t["codec"], t["duration"], t["timescale"]) == ("avc1", 75, 25)
    assert media.read_payload(mdat + moov, t) == b"abcdef"
    assert media.keyframes(t) == [(16, 17), (17, 19), (19, 22)]
    with pytest.raises(ValueError):
        media.read_container(struct.pack(">I4s", 999, b"moov"))


def test_container_features_of_broken_files(spark):
    good = media.write_container(media.padded(b"abc"))
    df = spark.createDataFrame([(1, good), (2, good[:-9]), (3, None)], "id long, media binary")
    got = {r.id: r for r in media.container_features(df, "id", "media").collect()}
    assert got[1].codec == "raw " and got[1].keyframe_ranges and got[2].error and 3 not in got


# 3


def brute_license(text):
    w = WORD.findall(lower(text))
    at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_license_scan(name, request):
    df = request.getfixturevalue(name)
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(df).collect())
    want = collections.Counter((r.doc_id, *brute_license(r.text)) for r in df.collect())
    assert got == want


def brute_blocks(text, templates):
    """Every block of every template, without filters: labels, score and the blocks that meet a notice's threshold."""
    w = WORD.findall(lower(text))
    labels, score, found = set(), 0.0, set()
    for t in templates:
        tokens, base_here = set(t.words), any(w[i : i + len(t.words)] == t.words for i in range(len(w)))
        for b in range(0, len(w), t.size):
            block = w[b : b + 2 * t.size]
            common = len(tokens & set(block))
            here = common >= t.need and (not t.base or any(block[i : i + len(t.words)] == t.words for i in range(len(block))))
            if here:
                labels.add(t.label)
                score = max(score, common / len(tokens))
                if not t.base:
                    found.add((t.label, b, b + len(block) - 1, round(common / len(tokens), 9)))
        assert not t.base or base_here == (t.label in labels)
    return ",".join(sorted(labels)), score, sorted(found)


def test_license_labels_against_all_blocks(docs, odd):
    for df in (docs, odd):
        got = collections.Counter(str((r.doc_id, r.labels, pytest.approx(r.score), [(b.label, b.first_word, b.last_word, round(b.share, 9)) for b in r.blocks])) for r in license_scan.license_scan(df).collect())
        want = collections.Counter(str((i, labels, pytest.approx(score), found)) for i, (labels, score, found) in ((r.doc_id, brute_blocks(r.text, license_scan.templates())) for r in df.select("doc_id", "text").collect()))
        assert got == want


def test_license_templates_of_many_lengths(spark):
    """Templates of 5 to 400 words, whole, with words changed, and cut short; all against brute force."""
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(900)]
    notices = {f"t{n}": " ".join(rng.choice(vocab, n)) for n in (5, 8, 9, 17, 64, 65, 130, 257, 400)}
    texts = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocab, int(rng.integers(0, 700))))]
        for _ in range(int(rng.integers(1, 4))):
            w = notices[str(rng.choice(list(notices)))].split()
            for _ in range(int(rng.integers(0, max(2, len(w) // 6)))):
                w[int(rng.integers(len(w)))] = "changed"
            parts += [" ".join(w[: int(rng.choice([len(w), len(w) - len(w) // 5]))]), " ".join(rng.choice(vocab, int(rng.integers(0, 40))))]
        texts.append((i, ", ".join(parts)))
    wanted = license_scan.templates(notices, 0.9)
    got = {r.doc_id: (r.labels, pytest.approx(r.score), [(b.label, b.first_word, b.last_word, round(b.share, 9)) for b in r.blocks]) for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string"), notices=notices).collect()}
    for i, t in texts:
        assert got[i] == brute_blocks(t, wanted)
    assert all(any(label in g[0].split(",") for g in got.values()) for label in notices)
    whole = license_scan.license_scan(spark.createDataFrame([(1, "x " * 777 + notices["t400"] + " y" * 99)], "doc_id long, text string"), notices=notices).first()
    assert "t400" in whole.labels and whole.score == 1.0
    with pytest.raises(ValueError):
        license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string"), notices={"x": "y " * 100_001})


def test_license_notices_across_blocks(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    texts = [(i, "filler " * i + notice + " and more " * 50) for i in range(0, 130, 7)] + [(1000, "filler " * 40 + "Released under the Apache License")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, _ in texts[:-1]:
        assert "gpl-free-software" in got[i].labels.split(",") and got[i].base_labels == "gpl" and got[i].score == 1.0
    assert got[1000].base_labels == "apache" and got[1000].first_word == 43


# 4


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    t = tokenizer()
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        want[r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    ids = dict(want.keys())
    pieces = rows(packing.pack(df, queries.TOKENIZER, queries.RANKS))
    spans = collections.defaultdict(list)
    for p in pieces:
        x = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(x)
        assert p["ids_crc32"] == zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        spans[p["doc_id"]].append((p["start"], p["start"] + p["length"]))
    for (i, x), n in want.items():
        covered = np.zeros(len(x), int)
        for a, b in spans[i]:
            covered[a:b] += 1
        assert (covered == n).all()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(100 * (i % 5), 100 * (i % 5) + 100, 300), 1).astype(np.uint16) for i in range(60)]
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    order = packing.chain(docs, np.log1p((60 - seen + 0.5) / (seen + 0.5)), 301.0)
    assert sorted(order) == list(range(60))
    assert np.mean([order[i] % 5 == order[i + 1] % 5 for i in range(59)]) > 0.8


def test_packing_fills_a_window_by_all_ids_of_its_seed():
    """Long queries and short neighbours: the window takes the seed's neighbours in the order of the whole BM25 score."""
    rng = np.random.default_rng(2)
    docs = [np.append(rng.choice(400, 200 if i == 0 else 20, replace=False), 400).astype(np.uint16) for i in range(120)]
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    idf, mean = np.log1p((120 - seen + 0.5) / (seen + 0.5)), np.mean([len(d) for d in docs])
    score = [sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.intersect1d(docs[0], d)) for d in docs]
    want = sorted(range(1, 120), key=lambda i: (-round(score[i], 9), i))
    got = packing.chain(docs, idf, mean)[1:]
    full = (2048 - 201) // 21
    assert len(got) == 119 and got[:full] == want[:full]


def test_packing_finds_neighbours_in_other_partitions(spark):
    """Each scan partition holds one document of each topic: a document's neighbours stand in others."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("bcdfgklmnprstvz"), 5)) for _ in range(40 * 130)]
    texts = [" ".join(rng.permutation(words[130 * t : 130 * t + 130])[:110]) for _ in range(8) for t in range(40)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 8), "doc_id long, text string")
    pieces = sorted(packing.pack(df, queries.TOKENIZER, queries.RANKS).collect(), key=lambda p: (p.sequence_id, p.offset))
    near = [a.doc_id % 40 == b.doc_id % 40 for a, b in zip(pieces, pieces[1:]) if a.sequence_id == b.sequence_id]
    assert np.mean(near) > 0.5


def bm25(docs, idf, mean, query):
    score = np.zeros(len(docs))
    for i, d in enumerate(docs):
        for t in np.intersect1d(query, d):
            tf = np.count_nonzero(d == t)
            score[i] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return score


@pytest.mark.parametrize("dense", [0.0, 0.2, 1.0])
def test_packing_search_equals_brute_force(monkeypatch, dense):
    """Top lists of unused documents by the whole BM25 score, before and after the index is laid out anew."""
    monkeypatch.setattr(packing, "DENSE", dense)
    rng = np.random.default_rng(5)
    docs = [np.append(rng.choice(300, rng.integers(5, 120)), 300).astype(np.uint16) for _ in range(240)]
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    idf, mean = np.log1p((240 - seen + 0.5) / (seen + 0.5)), float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, idf, mean)
    used = np.zeros(240, bool)
    for step in (0, 3, 2):
        if step:
            used[::step] = True
            for d in np.flatnonzero(used).tolist():
                index.use(d)
            if step == 2:
                index.lay(np.flatnonzero(~used))
        for d, (best, found) in zip(range(20), index.search([np.unique(docs[d]).astype(np.int64) for d in range(20)], 16), strict=True):
            score = bm25(docs, idf, mean, docs[d]) * ~used
            assert not used[best].any() and len(set(best.tolist())) == 16
            assert np.allclose(found, np.sort(score)[::-1][:16], rtol=1e-5) and np.allclose(score[best], found, rtol=1e-5)


def test_packing_shards_by_content(spark, monkeypatch):
    """More documents than a shard holds: like contents meet, so a shard finds most of what brute force over all documents finds (shards of scan order: a quarter)."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 60)
    monkeypatch.setattr(packing, "LEAF_DOCS", 8)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("bcdfgklmnprstvz"), 5)) for _ in range(20 * 130)]
    texts = [" ".join(rng.permutation(words[130 * t : 130 * t + 130])[:90]) for _ in range(12) for t in range(20)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 5), "doc_id long, text string")
    found = packing.recall(df, queries.TOKENIZER, queries.RANKS, every=3, k=8)
    assert found["queries"] == 80 and found["recall"] > 0.75 and found["score"] > 0.75
    pieces = packing.pack(df, queries.TOKENIZER, queries.RANKS).collect()
    assert {p.doc_id for p in pieces} == set(range(240)) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_encoder_equals_library_on_all_code_points():
    t, e = tokenizer(), packing.Encoder(queries.TOKENIZER, queries.RANKS)
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x30000, 64)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.ids(text).tolist() == want.ids


def test_packing_encodes_units_of_a_batch_as_the_library_does():
    """Units between spaces, white space of all kinds in runs and at ends, special strings, unsure characters, nulls; and slices of an array."""
    t, e = tokenizer(), packing.Encoder(queries.TOKENIZER, queries.RANKS)
    rng = np.random.default_rng(7)
    parts = ["a", "word", " the", " of", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'s", "'", "1", "½", "é", "日", "🙂", "\u0301", "<|endoftext|>", "\ua7ce", "\x00", "."]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)] + [t for _, t in ODD]
    want = [[*x.ids, 1] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for step in (5, 4096):
        got = []
        for first in range(0, len(texts), step):
            ids, bounds = e.ended(pa.array(texts, pa.string()).slice(first, step))
            got += [x.tolist() for x in np.split(ids, bounds[1:-1])]
        assert got == want
    assert [len(x) for x in e.ended(pa.array([], pa.string()))] == [0, 1]


def test_packing_encodes_equal_units_once(monkeypatch):
    """What reaches the BPE: each unit of a batch once, and the first of each text; whole texts only where white space stands before a space."""
    e = packing.Encoder(queries.TOKENIZER, queries.RANKS)
    seen = []
    monkeypatch.setattr(e, "bpe", type("Counting", (), {"encode_ordinary": lambda _, t, bpe=e.bpe: seen.append(len(t)) or bpe.encode_ordinary(t)})())
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"unit{i}," for i in range(50)], 300)) for _ in range(40)]
    ids, bounds = e.ended(pa.array(texts))
    assert sum(seen) < 0.02 * sum(map(len, texts))
    t = tokenizer()
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


@pytest.mark.parametrize("units", [1, 7, 1000])
def test_packing_encodes_in_blocks_of_units_as_the_library_does(monkeypatch, units):
    monkeypatch.setattr(packing, "UNITS", units)
    t, e = tokenizer(), packing.Encoder(queries.TOKENIZER, queries.RANKS)
    rng = np.random.default_rng(10)
    parts = ["a", "word", " the", " ", "  ", "\n", "\u3000", "1", "é", "日", "<|endoftext|>", "\ua7ce", "."]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(300)] + [t for _, t in ODD]
    ids, bounds = e.ended(pa.array(texts, pa.string()))
    want = [[*x.ids, 1] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == want


def test_packing_encodes_a_batch_in_few_times_its_memory():
    """7 MB of texts of many different units: what Python and numpy hold at once on the way to the ids."""
    e = packing.Encoder(queries.TOKENIZER, queries.RANKS)
    rng = np.random.default_rng(11)
    texts = pa.array([" ".join(f"unit{i}," for i in rng.integers(0, 400_000, 320)) for _ in range(2048)])
    e.ended(texts.slice(0, 8))
    tracemalloc.start()
    try:
        e.ended(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * texts.nbytes


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
@pytest.mark.parametrize("tokens", [1, 50, 1 << 20])
def test_packing_sets_of_documents(monkeypatch, kind, tokens):
    monkeypatch.setattr(packing, "SET_TOKENS", tokens)
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, rng.choice([3, 200, np.iinfo(kind).max]), rng.integers(0, 60), dtype=kind, endpoint=True) for _ in range(90)]
    terms, counts, bounds = packing.sets(docs)
    for d, a, b in zip(docs, bounds, bounds[1:], strict=False):
        want, n = np.unique(d, return_counts=True)
        assert terms[a:b].tolist() == want.tolist() and counts[a:b].tolist() == n.tolist()
    assert len(bounds) == 91 and terms.dtype == kind and len(terms) == len(counts) == bounds[-1]


# 5


def brute_components(pairs, k, percent):
    sets = [(i, frozenset(jaccard_join.exact_shingles(t, k))) for i, t in pairs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, u) = sets[a], sets[b]
            if s and u and i is not None and j is not None and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def near_copies(seed=3):
    """Groups of near copies at many distances, chains, a common passage and short texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, passage = [], list(rng.choice(vocab, 60))
    for _ in range(12):
        base = list(rng.choice(vocab, int(rng.integers(5, 150))))
        if rng.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(int(rng.integers(1, 9))):
            x = list(base)
            for _ in range(int(rng.integers(0, 6))):
                x[int(rng.integers(len(x)))] = str(rng.choice(vocab))
            base = x if rng.random() < 0.4 else base
            out.append(" ".join(x) if rng.random() < 0.8 else " ".join(x).upper())
    return [*((i + 1, t) for i, t in enumerate(out)), (9001, None), (9002, " "), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "one")]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 3), (5, 80, 4), (3, 60, 5)])
def test_jaccard_components(spark, k, percent, seed):
    data = near_copies(seed)
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), k, percent).collect())
    assert got == brute_components(data, k, percent)


@pytest.mark.parametrize("block", [1, 6])
@pytest.mark.parametrize("levels", [0, 2])
def test_jaccard_regions_of_several_parts(spark, monkeypatch, block, levels):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rng = np.random.default_rng(block)
    vocab = [f"w{i}" for i in range(300)]
    base = list(rng.choice(vocab, 120))
    data = []
    for i in range(70):
        x = list(base)
        for _ in range(int(rng.integers(0, 9))):
            x[int(rng.integers(len(x)))] = str(rng.choice(vocab))
        data.append((i + 1, " ".join(x)))
    k, percent = (3, 90) if block == 1 else (2, 75)
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), k, percent).collect())
    assert got == brute_components(data, k, percent)


def test_jaccard_cells_spare_comparisons(spark, monkeypatch):
    """One region of many near, unlinked documents in groups: cells compare far fewer members than all pairs of blocks would."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 8)
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(4000)]
    common, data = ["z1", "z2", "z3"], []
    for g in range(24):  # all documents share their rarest shingle; those of a group share most of the rest
        base = list(rng.choice(vocab, 60))
        for _ in range(12):
            x = list(base)
            for j in rng.choice(60, 4, replace=False):
                x[j] = str(rng.choice(vocab))
            data.append((len(data) + 1, " ".join(common + x)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    docs = df.selectExpr("doc_id", "text", "xxhash64(text) AS h")
    zero = spark.sparkContext.broadcast(np.zeros(jaccard_join.SLOTS, np.int64))
    classes = jaccard_join.described(docs, zero, 3, 90).selectExpr("*", "doc_id AS x").cache()
    compared = []
    plain = jaccard_join.compare

    def counted(rows, *args, **kw):
        rows = rows.cache()
        compared.append(sum(r["count"] ** 2 for r in rows.groupBy("c", "part").count().collect()))
        return plain(rows, *args, **kw)

    monkeypatch.setattr(jaccard_join, "compare", counted)
    comps = jaccard_join.linked_classes(classes.selectExpr("1L AS c", "x"), classes, docs, 3, 90)
    roots = {r.node: r.component for r in comps.collect()} if comps is not None else {}
    assert collections.Counter((i, len(jaccard_join.exact_shingles(t, 3)), roots.get(i, i)) for i, t in data) == brute_components(data, 3, 90)
    blocks = len(data) // 24
    assert sum(compared) < 0.5 * blocks * (blocks + 1) / 2 * 48**2


@pytest.mark.parametrize("k", [1, 3, 5])
def test_numbered_shingles_are_exact(k):
    texts = [t or "" for _, t in near_copies(6)][:30] + ["one", "one two", "one two one two one two"]
    texts = [t for t in texts if t.split()]
    sets = jaccard_join.numbered(texts, k)
    exact = [jaccard_join.exact_shingles(t, k) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    assert all(len(np.intersect1d(a, b)) == len(x & y) for a, x in zip(sets, exact, strict=True) for b, y in zip(sets, exact, strict=True))


def test_keep_one_keeps_other_texts_of_an_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, a, 1), (1, b, 2), (1, b, 3), (2, b, 4), (3, a + " eta", 5), (4, a, 6), (None, a, 7), (5, None, 8), (5, "", 9)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __h long"), 3, 80)
    assert kept.columns == ["doc_id", "text", "__h"]
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (1, b), (0, a), (5, ""), (5, "")])


def test_common_and_forest():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60 if i % 3 else 9000, int(rng.integers(1, 90)))).astype(np.uint64) for i in range(80)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (jaccard_join.common(sets) == want).all()
    links = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        links[a, b] = links[b, a] = True
    assert sorted(jaccard_join.forest(links)) == [(0, 3), (0, 5), (1, 2)]


def test_jaccard_documents(docs, odd):
    for df in (docs, odd):
        data = [(r.doc_id, r.text) for r in df.collect()]
        got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
        assert got == brute_components(data, 3, 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7000 + i) for i in range(50)] + [(7000, 200), (5, 5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[7000 + i] for i in range(50)} == {100} and got[200] == 100


# 6


def test_language_id(docs, odd):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in docs.collect() if langid.id_bucket(r.doc_id, 4) == 2]
    assert held and all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.9
    for r in langid.identify(odd, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_ppm_code_lengths_are_exact():
    """Sums of table costs equal a plain coder that walks the contexts byte by byte."""
    samples = {"a": [b"abracadabra", b"banana"], "b": [b"xyzzy xyz", b"zyx"]}
    model = langid.train(samples)
    counts = {}
    for lang, texts in samples.items():
        c = counts[lang] = collections.defaultdict(collections.Counter)
        for t in texts:
            s = [None] * 3 + list(t)
            for i in range(3, len(s)):
                for o in range(4):
                    c[tuple(s[i - o : i])][s[i]] += 1

    def p(c, context, x):
        n = c.get(context, {})
        shorter = p(c, context[1:], x) if context else 1 / 256
        total, distinct = sum(n.values()), len(n)
        if not total:
            return shorter
        return n[x] / (total + distinct) if x in n else distinct / (total + distinct) * shorter

    texts = [b"banabra xyz", b"\xff", b"", b"zz", b"q"]
    ends = np.cumsum([len(t) for t in texts])
    got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    for t, bits in zip(texts, got, strict=True):
        s = [None] * 3 + list(t)
        for lang, b in zip(model.langs, bits, strict=True):
            assert b == pytest.approx(-sum(np.log2(p(counts[lang], tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))), rel=1e-5)


def test_language_table_is_bounded(docs, monkeypatch):
    """With room for a tenth of the contexts the longer ones back off, and held-out rows are still told apart."""
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "TABLE_BYTES", whole.cost.nbytes // 10)
    model = langid.fit(docs)
    assert model.cost.nbytes <= whole.cost.nbytes // 10 + whole.cost[: whole.cost.shape[1]].nbytes
    held = [r for r in docs.collect() if langid.id_bucket(r.doc_id, 4) == 2]
    found = langid.predict_texts(model, [r.text for r in held])
    assert np.mean([f[0] == r.lang for f, r in zip(found, held, strict=True)]) > 0.9


# 7


def dense_trainer(positive, unlabelled, prior, steps=400):
    """Non-negative PU learning of a dense linear model over all words, by plain gradient steps."""
    words = sorted(set().union(*(toxicity.features(t) for t in positive)))
    at = {w: i for i, w in enumerate(words)}
    matrix = lambda texts: np.array([[float(w in f) for w in words] for f in (toxicity.features(t) for t in texts)])
    p, u = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(at)), float(np.log(prior / (1 - prior)))
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        zp, zu = p @ w + b, u @ w + b
        gp, gu = prior * (sigma(zp) - 1) / len(zp), sigma(zu) / len(zu)
        if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            gp = gp - prior * sigma(zp) / len(zp)
        else:
            gu = 0 * gu
        w, b = w - 0.5 * (p.T @ gp + u.T @ gu), b - 0.5 * (gp.sum() + gu.sum())
    return lambda t: float(sigma(sum(w[at[f]] for f in toxicity.features(t) if f in at) + b))


def test_toxicity_ranks_as_a_dense_trainer():
    """Made-up texts in which a few words mark the toxic ones: both trainers rank held-out toxic texts above the others, ours no worse."""
    rng = np.random.default_rng(9)
    common, bad = [f"word{i}" for i in range(60)], ["grimble", "snark", "vexed"]
    # features are letters only
    common = ["".join(chr(97 + int(c)) * 2 for c in w[4:]) + "on" for w in common]
    text = lambda toxic: " ".join([*rng.choice(common, 25), *(rng.choice(bad, 2) if toxic else [])])
    positive = [text(True) for _ in range(60)]
    unlabelled = [text(rng.random() < 0.2) for _ in range(200)]
    model, plain = toxicity.train(positive, unlabelled, 0.2), dense_trainer(positive, unlabelled, 0.2)
    good, toxic = [text(False) for _ in range(40)], [text(True) for _ in range(40)]
    auc = lambda score: np.mean([score(a) > score(b) for a in toxic for b in good])
    assert auc(plain) > 0.8 and auc(model.score) >= auc(plain) and auc(model.score) > 0.98


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([got[i].predicted == t for i, t in known.items() if got[i].held_out]) > 0.9
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in known)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}


# 8


def test_warc(spark, sf):
    got = {r.page_id: r for r in queries.op8_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    assert len(got) == len(pages)
    for r in pages:
        raw, f = (r.html or "").encode(), first[r.html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == r.page_id else "revisit", None if f == r.page_id else f)
        assert tuple(got[r.page_id])[1:] == want


@pytest.mark.parametrize("compress", [False, True])
def test_warc_payloads_and_odd_rows(spark, tmp_path, compress):
    big = "é日🙂\r\n0\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", None), (3, None, ""), (4, "u", big), (5, "u", "x"), (5, "u", "x"), (None, "u", "x"), (6, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", min_bytes=1, segment_bytes=5000, compress=compress)
    back = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(back) == len(pages) and not any(r.error for r in back)
    by = collections.defaultdict(list)
    for r in back:
        by[r.page_id].append(r)
    assert bytes(by[1][0].payload).decode() == big and by[4][0].refers_to == 1
    assert [by[i][0].record_type for i in (2, 3)] == ["response"] * 2 and by[6][0].refers_to == 5
    assert [r.record_type for r in by[5]] == ["response"] * 2


@pytest.mark.parametrize("archive", [3, 1500])
def test_warc_repeated_and_idless_long_pages(spark, monkeypatch, archive):
    """Rows that share a page id, or have none, keep records of their own; archives of 3 records tear their segments apart."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", archive)
    a, b = "long a " * 9000, "long b " * 9000
    pages = [(1, "u", a), (1, "u", a), (2, "u", a), (2, "u", b), (3, "u", b), (None, "u", a), (None, "u", b), (None, "u", "c"), (4, "u", None), (5, "u", ""), (6, "u", "c")]
    back = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert not any(r.error for r in back)
    name = {a: "a", b: "b", "c": "c", "": "empty"}
    digests = {base64.b32encode(hashlib.sha1(k.encode()).digest()).decode(): v for k, v in name.items()}
    got = collections.Counter((r.page_id, digests[r.payload_digest], r.record_type, r.refers_to) for r in back)
    assert got == collections.Counter([
        (1, "a", "response", None), (1, "a", "response", None), (2, "a", "revisit", 1), (2, "b", "response", None), (3, "b", "revisit", 2),
        (None, "a", "response", None), (None, "b", "response", None), (None, "c", "response", None), (4, "empty", "response", None), (5, "empty", "revisit", 4), (6, "c", "response", None),
    ])


def test_warc_segments_in_other_archives(spark, tmp_path):
    html = "words é " * 2000
    records = warc.page_records(7, "u", html, None, 3000) + warc.page_records(8, "v", "x" * 9000, None, 4000)[:-1]
    for i, r in enumerate(records):
        (tmp_path / f"{i}.warc").write_bytes(r)
    (tmp_path / "z.warc").write_bytes(b"WARC/1.1\r\nnothing")
    back = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [bytes(r.payload).decode() for r in back if not r.error] == [html]
    assert sorted(r.record_type or "" for r in back if r.error) == ["", "response"]


def test_warc_damage():
    parts = warc.page_records(1, "u", "text " * 900, None, 1000)
    found = [(h, b) for r in parts for h, b in warc.parse(r)]
    segments = [(int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, b) for h, b in found]
    assert warc.http_payload(warc.joined(segments[::-1])).decode() == "text " * 900
    for bad in (segments[:-1], segments[1:], segments[:1] + segments[2:], [*segments[:-1], (segments[-1][0], 7, segments[-1][2])]):
        with pytest.raises(ValueError):
            warc.joined(bad)
    with pytest.raises(ValueError):
        list(warc.parse(parts[0][:-5]))
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab")
    assert warc.dechunk(warc.chunked(b"ab" * 9999)) == b"ab" * 9999


# 9


def test_html_documents(spark, sf):
    import html

    for r in html_text.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        a = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", re.sub(r"<!--.*?-->", "", a, flags=re.S))))
        want = "\n".join(y for y in (re.sub(r"\s+", " ", html.unescape(z)).strip() for z in a.split("\n")) if y)
        assert (r.text, r.n_chars) == (want, len(want))


def test_html_without_article():
    page = """<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="content"><h2>Title</h2>
    <p>First <a href=x>para</a> &amp; text long enough to be the main one of all.<p>Second para with a <b>bold</b> word<br>and more words here, plenty of them.
    <div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><ul><li>item one<li>item two</ul></div><div class="sidebar"><p>Side text</p></div></div>
    <div id="comments"><p>A reader's very long comment that is longer than everything else here, and goes on and on until it ends somewhere.</p></div><form><p>Subscribe</p></form>"""
    assert html_text.extract(page) == "Title\nFirst para & text long enough to be the main one of all.\nSecond para with a bold word and more words here, plenty of them.\nitem one\nitem two"
    wrapped = """<body class="nav-open"><div class="page with-sidebar"><div id="sidebar-layout"><div class="article-header header">Top</div><main><article><div class="post-header"><h1>Head</h1></div>
    <p>Body words.</p><div class="share-buttons">Share</div><section class="comments"><p>Comment</p></section></article></main><aside>Side</aside></div></div></body>"""
    assert html_text.extract(wrapped) == "Head\nBody words."
    plain = "<div class='layout no-sidebar'><p>Only words of an article that has no other mark than this one.</p><p>More of them.</p></div><ul class='menu'><li>one</li></ul>"
    assert html_text.extract(plain) == "Only words of an article that has no other mark than this one.\nMore of them."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>var a = '<p>x</p>'</script>") == ""
    assert html_text.extract("only words &lt;here&gt;") == "only words <here>"
    assert html_text.extract("<p>a" + "<div>" * 3000 + "deep words</p>").endswith("deep words")


def test_html_keeps_what_names_and_siblings_suggest_to_drop():
    words = "word and more words in it. " * 12
    body = words.strip()
    assert html_text.extract(f'<div class="related-work"><p>{words}</p></div>') == body
    assert html_text.extract(f'<ul class="nav"><li>one</li></ul><div class="notice-of-law"><p>{words}</p></div><p>x</p>') .split("\n")[0] in (body, "one")
    assert html_text.extract(f"<body><nav>x</nav><section><h2>A</h2><p>{words}</p></section><section><h2>B</h2><p>{words}</p></section></body>") == f"A\n{body}\nB\n{body}"
    assert html_text.extract(f'<body><div><p>{words}</p><p>{words}</p></div><div class="comments"><p>{words * 5}</p></div></body>') == f"{body}\n{body}"
    assert html_text.extract(f"<body><div>{words}<p>{words}</p></div><div><a href=1>one</a><a href=2>two</a><a href=3>three</a></div></body>") == f"{body}\n{body}"
    assert html_text.extract("a < b <3 </> c<!-->d<!x>e") == "a < b <3 cde"


def test_html_without_article_elements(spark, sf):
    """Density alone finds the same text when the page does not name its article."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.extract(bare) == html_text.extract(r.html)


@pytest.mark.parametrize("part", ['<a title="', "<p a='\"", "<div>", "</p><span>", "<b><table><span></b>", "<!", "<script></script ", "<td><p>", "<"])
def test_html_broken_pages_take_linear_time(part):
    import time

    began = time.perf_counter()
    html_text.extract("<p>words</p>" + part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 10


def test_html_densities_against_a_plain_version():
    """Composite densities and their sums by the formula, node by node, with counts taken anew for each node."""
    import math

    page = "<body><div><p>Some words here</p>bare text<p>More <a href=x>linked</a> words <b>there</b></p></div><ul><li><a>one</a><li><a>two</a> and</ul></body>"
    root = html_text.parse(page)
    order, _ = html_text.measure(root, True)
    body = next(n for n in order if n.tag == "body")
    html_text.weigh(order, body)
    node = html_text.Node

    def chars(n, linked):
        return sum((len("".join(x.split())) if not linked or n.tag == "a" else 0) if isinstance(x, str) else chars(x, linked and n.tag != "a") for x in n.items)

    def tags(n, kind):
        return sum((kind in (None, x.tag)) + tags(x, kind) for x in n.items if isinstance(x, node))

    def plain(c, t, lc, lt):
        base = math.log(c / max(1, c - lc) * lc + chars(body, True) / chars(body, False) * c + math.e)
        return c / max(1, t) * max(0, math.log(c / max(1, lc) * max(1, t) / max(1, lt)) / base)

    of = lambda n: plain(chars(n, False), tags(n, None), chars(n, True), tags(n, "a")) if chars(n, False) else 0
    for n in order:
        if n.tag == "a" or n is root:
            continue
        assert n.density == pytest.approx(of(n))
        assert n.sum == pytest.approx(sum(plain(len("".join(x.split())), 0, 0, 0) if isinstance(x, str) else of(x) if x.tag != "a" else x.density for x in n.items))


# 10


def brute_contamination(documents, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    sizes = {len(k) for k in windows}
    out = collections.Counter()
    for i, t in documents:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_contamination(spark, sf, name, request):
    df = request.getfixturevalue(name)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "Plain WORDS"), (901, "plain words"), (902, None), (903, " . "), (904, "word " * 20)], "item_id long, text string")
    items = items.union(extra)
    got = collections.Counter(tuple(r) for r in decontam.contamination(df, items).collect())
    assert got == brute_contamination([(r.doc_id, r.text) for r in df.collect()], [tuple(r) for r in items.collect()])


def test_keep_clean_decides_each_row(spark):
    """Rows without an id, or with one id, of which one is contaminated: the others stay."""
    item = " ".join(f"t{i}" for i in range(13))
    docs = [(None, item), (None, "clean words"), (None, None), (5, "a " + item), (5, "other clean words"), (6, item), (None, "clean words")]
    kept = decontam.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert collections.Counter(tuple(r) for r in kept.collect()) == collections.Counter([docs[1], docs[2], docs[4], docs[6]])


def test_contamination_by_items_without_id(spark):
    """Their windows count, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    item, other = " ".join(f"t{i}" for i in range(13)), " ".join(f"u{i}" for i in range(13))
    docs = [(1, "a " + item), (2, item + " " + other), (3, "clean words"), (4, other)]
    items = [(None, item), (7, other), (None, other), (8, None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = c.execute(queries.OP10_SQL).fetchall()
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    assert sum(r[5] for r in want) == 3


def test_contamination_in_blocks(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 50)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").limit(10)
    got = collections.Counter(tuple(r) for r in decontam.contamination(docs, items).collect())
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = [(1, "a b " + item), (2, item.replace("t5", "x t5 y")), (3, "t0 t1 t2")]
    found = decontam.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), slop=2)
    assert {r.doc_id for r in found.collect()} == {1, 2}


def test_empty_tables(spark):
    empty, pages = spark.createDataFrame([], DOC), spark.createDataFrame([], "page_id long, url string, html string")
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = langid.fit(empty)
    for df in (
        token_counts.token_counts(empty, queries.TOKENIZER), media.media_columns(empty), license_scan.license_scan(empty), packing.pack(empty, queries.TOKENIZER, queries.RANKS), jaccard_join.jaccard_components(empty),
        langid.identify(empty, model), toxicity.score(empty, toxicity.fit(empty, labels)), warc.round_trip(pages), html_text.main_text(pages), decontam.contamination(empty, items),
    ):
        assert df.collect() == []


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        want = c.sql(sql)
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        at = [want.columns.index(n) for n in names]
        assert collections.Counter(tuple(r[i] for i in at) for r in want.fetchall()) == collections.Counter(tuple(r) for r in df.select(*names).collect())


def test_jaccard_ids_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y"), (1, None), (1, " "), (2, "a b c d e f"), (3, "u v w x y"), (3, "u v w x y")]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 3, 1), (1, 4, 1), (2, 4, 1), (3, 3, 1), (3, 3, 1)]
