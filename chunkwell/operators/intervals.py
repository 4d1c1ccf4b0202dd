"""Interval analytics: merged sets, union length, overlap, concurrency, and merging of byte ranges.

Intervals are columns start and end, half-open, of a key.  A window over a key alone would put a hot key into one
task, so windows run within buckets of a key; only a row for each bucket is scanned by key, and what it finds is carried into the bucket.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _merge(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("__g", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def merged(df: DataFrame, key: str, gap: int = 0, bucket: int = 1 << 16) -> DataFrame:
    """Disjoint sorted intervals of each key; touching ones, and those at most gap apart, become one."""
    spans = df.where("start < end").select(key, F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    local = _merge(spans.withColumn("__b", F.floor(F.col("start") / bucket).cast("bigint")), [key, "__b"], gap)
    within, along = W.partitionBy(key, "__b").orderBy("start"), W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    # the end that reaches into each bucket from those before it
    tops = local.groupBy(key, "__b").agg(F.max("end").alias("__top")).withColumn("__top", F.max("__top").over(along))
    before = F.greatest(F.max("end").over(within.rowsBetween(W.unboundedPreceding, -1)), F.col("__top"))
    marked = local.join(tops, [key, "__b"]).withColumn("__new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    # numbers of the merged intervals: those of the buckets before, and those of the bucket so far
    offsets = marked.groupBy(key, "__b").agg(F.sum("__new").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    numbered = marked.join(offsets, [key, "__b"]).withColumn("__g", F.col("__n") + F.sum("__new").over(within.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def union_length(df: DataFrame, key: str) -> DataFrame:
    return merged(df, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def total(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("total"))


def concurrency(df: DataFrame, key: str, bucket: int = 1 << 16) -> DataFrame:
    """peak: most intervals open at once, where at one instant opens count before closes; busy: time with any open; open_time:
    time times the number open; mean: open_time / busy, zero if never busy."""
    opens = df.select(key, F.col("start").cast("bigint").alias("at"), F.lit(1).alias("delta"))
    closes = df.select(key, F.col("end").cast("bigint").alias("at"), F.lit(-1).alias("delta"))
    events = opens.unionAll(closes).groupBy(key, "at", "delta").agg(F.sum("delta").alias("change")).withColumn("__b", F.floor(F.col("at") / bucket).cast("bigint"))
    along = W.partitionBy(key).orderBy("__b")
    # the number open before each bucket, and the first instant after it
    ahead = events.groupBy(key, "__b").agg(F.sum("change").alias("__open"), F.min("at").alias("__at"))
    ahead = ahead.select(key, "__b", F.coalesce(F.sum("__open").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__open"), F.lead("__at").over(along).alias("__next"))
    order = W.partitionBy(key, "__b").orderBy("at", F.desc("delta"))
    run = events.join(ahead, [key, "__b"]).withColumn("open", F.col("__open") + F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("dt", F.coalesce(F.lead("at").over(order), F.col("__next")) - F.col("at"))
    out = run.groupBy(key).agg(F.max("open").alias("peak"), F.coalesce(F.sum(F.when(F.col("open") > 0, F.col("dt"))), F.lit(0)).alias("busy"), F.coalesce(F.sum(F.col("open") * F.col("dt")), F.lit(0)).alias("open_time"))
    return out.withColumn("mean", ratio(F.col("open_time"), F.col("busy")))


def ratio(a: Column, b: Column) -> Column:
    """Zero where the divisor is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def overlap(a: DataFrame, b: DataFrame, key: str, bucket: int = 1 << 16) -> DataFrame:
    """Length of the intersection of two interval sets of each key: both merged, cut into buckets, and joined on them."""
    def cut(df: DataFrame, side: str) -> DataFrame:
        m = merged(df, key).withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("bigint"), F.floor((F.col("end") - 1) / bucket).cast("bigint"))))
        lo, hi = F.greatest("start", F.col("__b") * bucket), F.least("end", (F.col("__b") + 1) * bucket)
        return m.select(key, "__b", lo.alias(f"{side}0"), hi.alias(f"{side}1"))

    both = cut(a, "a").join(cut(b, "b"), [key, "__b"]).withColumn("n", F.least("a1", "b1") - F.greatest("a0", "b0")).where("n > 0")
    return both.groupBy(key).agg(F.sum("n").alias("shared"))


def coalesce_ranges(df: DataFrame, key: str, gap: int, span: int) -> DataFrame:
    """Covers of byte ranges by file: neighbours join across a gap while the cover has at most span bytes.  The cap makes the rule
    depend on order, so each file is swept once in Python; ranges of one file are its chunks, a bounded number."""
    from ..sources.bytesource import merge_ranges

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge_ranges(zip(pdf["start"].tolist(), pdf["end"].tolist(), strict=True), gap, span)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "start": [a for a, _ in out], "end": [b for _, b in out]})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col("start").cast("bigint"), F.col("end").cast("bigint")).groupBy(key).applyInPandas(sweep, f"{key} {kind}, start bigint, end bigint")


def clamp(start: Column, end: Column, size: Column) -> Column:
    """The part of a range inside a file; null if there is none."""
    return F.when(start < F.least(end, size), F.struct(start.alias("start"), F.least(end, size).alias("end")))
