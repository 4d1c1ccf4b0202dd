"""Language identification by prediction by partial matching.

For every language a variable-order tree of byte contexts holds counts; a text's cost is its exact
code length in bits when each byte is coded with the longest known context and escapes to shorter
ones (method C, with exclusion left out).  Counts are frozen while coding, so the cost of a byte
depends on the bytes before it only, and the tree can be laid out as one table of costs:
a row per context that any language knows, a column per byte value seen, a plane per language.  Contexts that no language knows have no
row; where the table would pass ``TABLE_BYTES``, the longer contexts that training saw least have none either and back off, so the broadcast is bounded
whatever the number of languages.

Bytes never seen in training cost the same under every language.  The last context is uniform
over 256 values.

Training takes the ``LANGS`` most frequent languages, at most ``DOCS_PER_LANG`` documents of a language and ``BYTES_PER_LANG`` bytes of
them (whole documents of at most ``MAX_DOC_BYTES``); scoring always reads whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0; without any training
rows every text is ``und``; ties go to the alphabetically first language; a null lang is not learned; of rows that share id and language
one is learned; repeated rows give one row each; an empty table gives no rows; a long text is scored in a slice of its own; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, hash_share, id_bucket, id_bucket_col, tidy

ORDER, LANGS, DOCS_PER_LANG, BYTES_PER_LANG, MAX_DOC_BYTES, TABLE_BYTES = 3, 256, 400, 1_000_000, 65_536, 64 << 20
SLICE_BYTES = 256 << 10
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
_LETTER = re.compile(r"[^\W\d_]")


class Model:
    """cost[row, symbol, lang] in bits; row_of[c3, c2, c1] is the row of a context of symbols.

    Symbols: 0 is the start of a text, 1 any byte not seen in training, then the bytes seen.
    """

    def __init__(self, langs: list[str], symbol: np.ndarray, row_of: np.ndarray, cost: np.ndarray):
        self.langs, self.symbol, self.row_of, self.cost = langs, symbol, row_of, cost

    def lengths(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text raw[starts:ends] under each language; texts lie end to end in raw."""
        out = np.zeros((len(starts), len(self.langs)))
        if not len(raw):
            return out
        s = self.symbol[raw].astype(np.int32)
        n, k = len(s), self.cost.shape[1]
        begin = starts[ends > starts]
        context = np.zeros(n, np.int32)
        for back in (3, 2, 1):
            p = np.zeros(n, np.int32)
            p[back:] = s[:-back] if n > back else s[:0]
            for j in range(back):  # what lies before the text is its start
                at = begin + j
                p[at[at < n]] = 0
            # a start that reaches into the next short text is overwritten there by its own start
            context = context * k + p
        bits = self.cost.reshape(-1, len(self.langs))[self.row_of[context].astype(np.int64) * k + s]
        filled = np.flatnonzero(ends > starts)
        if len(filled):
            out[filled] = np.add.reduceat(bits, starts[filled], axis=0, dtype=np.float64)
        return out


def train(samples: dict[str, list[bytes]]) -> Model | None:
    """samples: texts of each language."""
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    seen = np.unique(np.concatenate([np.unique(np.frombuffer(t, np.uint8)) for k in langs for t in samples[k] if t]))
    symbol = np.ones(256, np.uint8) if len(seen) < 254 else np.ones(256, np.uint16)
    symbol[seen] = np.arange(2, len(seen) + 2)
    k = len(seen) + 2
    # n-grams of symbols with their contexts: a text starts after three start symbols
    grams = []
    for lang in langs:
        parts = []
        for t in samples[lang]:
            s = np.concatenate([[0, 0, 0], symbol[np.frombuffer(t, np.uint8)].astype(np.int64)])
            parts.append(((s[:-3] * k + s[1:-2]) * k + s[2:-1]) * k + s[3:])
        grams.append(np.unique(np.concatenate(parts), return_counts=True))
    # rows: all contexts of order 1, then the known ones of orders 2 and 3, as many of the most frequent as the table may hold
    seen3 = np.concatenate([g // k for g, _ in grams])
    often = np.concatenate([n for _, n in grams])
    rows2, n2 = summed(seen3 % k**2, often)
    rows3, n3 = summed(seen3, often)
    most = max(0, TABLE_BYTES // (4 * k * len(langs)) - k)
    if len(rows2) + len(rows3) > most:
        kept = np.sort(np.argsort(-np.concatenate([n2, n3]), kind="stable")[:most])
        rows2, rows3 = rows2[kept[kept < len(rows2)]], rows3[kept[kept >= len(rows2)] - len(rows2)]
    row2 = (np.arange(k**2) % k).astype(np.int32)
    row2[rows2] = k + np.arange(len(rows2))
    row_of = row2[np.arange(k**3) % k**2]
    row_of[rows3] = k + len(rows2) + np.arange(len(rows3))
    cost = np.zeros((k + len(rows2) + len(rows3), k, len(langs)), np.float32)
    for i, (g, n) in enumerate(grams):
        p0 = np.full(k, 1 / 256)  # order -1
        p = mixed(np.bincount(g % k, n, k)[None], p0[None])[0]  # order 0
        p1 = mixed(np.bincount(g % k**2, n, k**2).reshape(k, k), np.broadcast_to(p, (k, k)))
        p2 = mixed(np.bincount(g % k**3, n, k**3).reshape(k * k, k), p1[np.arange(k * k) % k])
        at = np.searchsorted(rows3, g // k)
        there = at < len(rows3)
        there[there] = rows3[at[there]] == (g // k)[there]
        quad = np.bincount(at[there] * k + (g % k)[there], n[there], len(rows3) * k).reshape(-1, k)
        for first, p in ((0, p1), (k, p2[rows2]), (k + len(rows2), mixed(quad, p2[rows3 % k**2]))):
            cost[first : first + len(p), :, i] = -np.log2(p)
    return Model(langs, symbol, row_of, cost)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their n."""
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, n, len(out))


def mixed(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities with escape: a context with total t and d distinct symbols codes a seen symbol with n/(t+d)
    and escapes with d/(t+d); a context never seen escapes for free."""
    t, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(counts > 0, counts / (t + d), d / (t + d) * shorter)
    return np.where(t > 0, p, shorter)


def learning_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, parts: int, held: int) -> DataFrame:
    """Rows with a language outside the held-out fold, at most DOCS_PER_LANG of each language, chosen by a hash of the id."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (id_bucket_col(F.col("doc_id"), parts) != held))
    # ids are chosen without reading texts
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not counts:
        return rows
    share = reduce(lambda a, b: a | b, [(F.col("lang") == lang) & hash_share("doc_id", n, DOCS_PER_LANG) for lang, n in counts.items()])
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), F.col("doc_id"))
    keys = rows.select("doc_id", "lang").where(share).withColumn("k", F.row_number().over(order)).where(F.col("k") <= DOCS_PER_LANG).select("doc_id", "lang")
    chosen = rows.where(F.octet_length("text") <= MAX_DOC_BYTES).join(F.broadcast(keys), ["doc_id", "lang"], "left_semi")
    return chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # an id that comes often is learned once


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> Model | None:
    samples: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in sorted(learning_rows(df, id_col, text_col, lang_col, parts, held).collect(), key=lambda r: (r.lang, str(r.doc_id), r.text)):
        raw = r.text.encode()
        if raw and size.get(r.lang, 0) + len(raw) <= BYTES_PER_LANG:
            samples.setdefault(r.lang, []).append(raw)
            size[r.lang] = size.get(r.lang, 0) + len(raw)
    return train(samples)


def posterior(bits: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Share of the best language, with the code lengths tempered to at most 64 bytes of evidence."""
    scale = np.minimum(1, 64 / np.maximum(n_bytes, 1))[:, None]
    w = np.exp2((bits.min(1, keepdims=True) - bits) * scale)
    return w.max(1) / w.sum(1)


def predict_texts(model: Model | None, texts: list[str | None]):
    """(language, score, bits per byte) of each text; slices bound the memory, a long text has a slice of its own."""
    out: list[tuple[str, float, float | None]] = []
    raws = [(t or "").encode() for t in texts]
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) <= SLICE_BYTES):
            size += len(raws[j])
            j += 1
        n = np.array([len(r) for r in raws[i:j]])
        ends = np.cumsum(n)
        if model is not None:
            bits = model.lengths(np.frombuffer(b"".join(raws[i:j]), np.uint8), ends - n, ends)
            best, score = bits.argmin(1), posterior(bits, n)
            rate = bits.min(1) / np.maximum(n, 1)
        for m in range(j - i):
            t = texts[i + m]
            if model is None or not t or not _LETTER.search(t):
                out.append(("und", 0.0, None))
            else:
                out.append((model.langs[best[m]], float(score[m]), float(rate[m])))
        i = j
    return out


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, held: int = 2) -> DataFrame:
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            found = predict_texts(shared.value, b.column(1).to_pylist())
            lang, score, rate = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([id_bucket(i, parts) == held for i in ids], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA)


def keep_known(df: DataFrame, model: Model | None, text_col: str = "text", max_bits_per_byte: float = 8.0) -> DataFrame:
    """Rows whose text has a language: it has a letter, and some language codes it in fewer bits than plain bytes take.

    All columns stay, whatever their names.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches):
        for b in batches:
            found = predict_texts(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([x[0] != "und" and x[2] < max_bits_per_byte for x in found], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
