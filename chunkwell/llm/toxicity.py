"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is trained in numpy from confirmed toxic documents (P)
and unlabelled ones (U).  With class prior pi and the logistic loss l, the risk is
``pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))``; where the bracket falls below zero only the first
term gives a gradient, as that of the maximum does.  Features are the presence of a word and of its
prefixes, so inflected forms share weight.  Only features that are clearly more frequent in P than
in U are trained (``SCREEN_Z`` standard errors and ``SCREEN_RATIO`` times), and soft thresholding
shrinks their weights, which stay non-negative, so the chance words of long clean documents carry none.
The bias is then set where the same corrected risk, of the zero-one loss, is least.

Training takes at most ``POSITIVES`` and ``UNLABELLED`` documents of at most ``MAX_DOC_BYTES``, chosen by a hash of the id;
scoring reads whole texts.  The prior is the share of toxic documents among the labelled rows of
the learning fold.

Defined cases: null and empty texts get the score of the bias alone; without positives every
score is 0; of rows that share an id one is learned; repeated rows give one row each; ids may be null; an empty table gives no rows; a long
text is scored whole by one task; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_sample, id_bucket, id_bucket_col, tidy

POSITIVES, UNLABELLED, MAX_DOC_BYTES, PREFIXES = 2000, 4000, 65_536, (4, 5, 6)
KNOWN_WORDS = 100_000
SCREEN_Z, SCREEN_RATIO, SUPPORT = 5.0, 2.5, 0.02
EPOCHS, BATCHES, RATE, SHRINK, CLIP = 60, 8, 0.05, 1e-3, 1e-6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Lower-case words of letters, and their prefixes marked by a tilde."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:k] + "~" for w in words for k in PREFIXES if len(w) >= k}


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {k: v for k, v in weights.items() if k[-1] != "~"}
        self.prefixes = {k: {w[:-1]: v for w, v in weights.items() if w[-1] == "~" and len(w) == k + 1} for k in PREFIXES}
        self.known: dict[str, tuple] = {}

    def hits(self, word: str) -> tuple:
        """The model's features that a word sets, kept for the words seen so far."""
        got = self.known.get(word)
        if got is None:
            got = tuple(x for x in (word if word in self.words else None, *(word[:k] + "~" for k in PREFIXES if len(word) >= k and word[:k] in self.prefixes[k])) if x)
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def score(self, text: str | None) -> float:
        if not text:
            return sigmoid(self.bias)
        found = set()
        for w in set(_WORD.findall(text.lower())):
            found.update(self.hits(w))
        return sigmoid(self.bias + sum(self.words[x] if x[-1] != "~" else self.prefixes[len(x) - 1][x[:-1]] for x in sorted(found)))


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Sparse:
    """0/1 rows as column numbers end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = np.array([len(r) for r in rows])
        self.cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], len(self.n))

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, g[self.row], size)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def screened(positive: list[str], unlabelled: list[str]) -> dict[str, int]:
    """Features of a share SUPPORT of P whose share there exceeds that of U by SCREEN_Z standard errors and SCREEN_RATIO times,
    with their column numbers.  One document's features are held at a time, besides the counts of P."""
    in_p: Counter = Counter()
    for t in positive:
        in_p.update(features(t))
    n_p, n_u = len(positive), max(1, len(unlabelled))
    in_p = {f: n for f, n in in_p.items() if n >= max(4, SUPPORT * n_p)}
    in_u: Counter = Counter()
    for t in unlabelled:
        in_u.update(features(t) & in_p.keys())
    out = []
    for f, n in in_p.items():
        p, u, both = n / n_p, in_u[f] / n_u, (n + in_u[f]) / (n_p + n_u)
        if p >= SCREEN_RATIO * u and p - u >= SCREEN_Z * (both * (1 - both) * (1 / n_p + 1 / n_u)) ** 0.5:
            out.append(f)
    return {f: i for i, f in enumerate(sorted(out))}


def train(positive: list[str], unlabelled: list[str], prior: float, seed: int = 7) -> Model:
    """Non-negative PU training of a sparse linear model."""
    if not positive:
        return Model({}, -60.0)
    positive, unlabelled = list(dict.fromkeys(positive)), list(dict.fromkeys(unlabelled))  # copies would vouch for chance words
    at = screened(positive, unlabelled)
    names = list(at)
    index = lambda texts: [np.sort(np.array([at[f] for f in features(t) if f in at], np.int64)) for t in texts]
    rows_p, rows_u = index(positive), index(unlabelled)
    size, rng = len(names), np.random.default_rng(seed)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    mean_w, mean_b, kept = np.zeros(size), 0.0, 0
    for epoch in range(EPOCHS):
        order_p, order_u = rng.permutation(len(rows_p)), rng.permutation(len(rows_u))
        for k in range(BATCHES):
            p = Sparse([rows_p[i] for i in order_p[k::BATCHES]])
            u = Sparse([rows_u[i] for i in order_u[k::BATCHES]])
            if not len(p.n):
                continue
            zp = p.dot(w) + b
            zu = u.dot(w) + b if len(u.n) else np.zeros(0)
            # gradients of log(1+e^-z) and log(1+e^z)
            as_positive = (logistic(zp) - 1) / len(zp)
            as_negative = logistic(zp) / len(zp)
            of_unlabelled = logistic(zu) / max(1, len(zu))
            rest = np.logaddexp(0, zu).sum() / max(1, len(zu)) - prior * np.logaddexp(0, zp).mean()
            gp, gu = (prior * as_positive - prior * as_negative, of_unlabelled) if rest >= 0 else (prior * as_positive, 0 * of_unlabelled)
            g = np.append(p.back(gp, size) + (u.back(gu, size) if len(zu) else 0), gp.sum() + gu.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + CLIP)
            w, b = w - move[:-1], b - move[-1]
            w = np.maximum(w - SHRINK, 0)  # screened features speak for toxicity or not at all
        if epoch >= EPOCHS // 2:  # the mean of the later epochs is steadier than the last one
            mean_w, mean_b, kept = mean_w + w, mean_b + b, kept + 1
    w, b = mean_w / kept, mean_b / kept
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, b - cut(Sparse(rows_p).dot(w) + b, Sparse(rows_u).dot(w) + b, prior))


def cut(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The logit that becomes 0: where the class-prior-corrected zero-one risk ``2 pi P(z_P < t) + P(z_U >= t)`` is least, in the
    middle of the widest such interval."""
    z = np.unique(np.concatenate([zp, zu]))
    if len(z) < 2:
        return 0.0
    t = (z[1:] + z[:-1]) / 2
    risk = 2 * prior * np.searchsorted(np.sort(zp), t) / len(zp) + 1 - np.searchsorted(np.sort(zu), t) / max(1, len(zu))
    best = np.flatnonzero(risk <= risk.min() + 1e-9)
    return float(t[best[np.argmax(z[best + 1] - z[best])]])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held: int = 0) -> Model:
    """P: toxic rows of the learning fold; U: any rows of it, whose labels are not looked at."""
    learn = id_bucket_col(F.col("doc_id"), parts) != held
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(learn)
    known = labels.select(F.col("doc_id"), F.col("toxic")).where(F.col("toxic").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
    if not share:
        return Model({}, -60.0)
    prior = min(max(share, 0.01), 0.5)
    # ids are sampled without reading texts; one pass then brings the texts of both samples
    chosen = hash_sample(known.where("toxic = 1").select("doc_id"), "doc_id", POSITIVES).withColumn("p", F.lit(1))
    chosen = chosen.unionByName(hash_sample(docs.select("doc_id"), "doc_id", UNLABELLED, 1).withColumn("p", F.lit(0)))
    chosen = chosen.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    rows = docs.where(F.octet_length("text") <= MAX_DOC_BYTES).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("p").alias("p"), F.min("u").alias("u")).collect()  # an id that comes often is learned once
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows if r.p == 1][: 2 * POSITIVES], [r.text for r in rows if r.u == 0][: 2 * UNLABELLED], prior)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held: int = 0) -> DataFrame:
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            s = [shared.value.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([id_bucket(i, parts) == held for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, lambda: shared.value.known), SCHEMA)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows that score below the limit, with all their columns."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(tidy(run, lambda: shared.value.known), df.schema)
