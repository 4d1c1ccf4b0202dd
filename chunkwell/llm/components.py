"""Connected components of an edge table, by alternating large and small stars.

Each round joins edges with the smallest neighbour of each node, which is a grouped minimum (summed
map-side), so a hub's edges are never gathered in one task.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v.  Large star: neighbours above a node move to its smallest neighbour; small star: those below."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame):
    """Equal for equal edge tables: number, sum of ends and sum of hashes."""
    return edges.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node with an edge.  edges: a, b; loops and repeats do no harm."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _mark(now)
    for _ in range(MAX_ROUNDS):
        now = materialise(_stars(_stars(now, True), False), "stars")
        # done when every node points to its component's smallest
        new = _mark(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
