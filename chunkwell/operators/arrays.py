"""Operators on array axes: column assembly, resampling, rolling windows, strided and point selections, chunk arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def assemble(columns: dict[str, DataFrame], on: tuple[str, ...] = ("i0",)) -> DataFrame:
    """Datasets of the same extent side by side: an equi-join on their index columns."""
    named = [df.withColumnRenamed("value", name) for name, df in columns.items()]
    return reduce(lambda a, b: a.join(b, list(on)), named)


def resample(df: DataFrame, width: int, *aggs: Column, axis: str = "i0") -> DataFrame:
    """Aggregates over blocks of width places of an axis; bucket is the number of the block."""
    return df.groupBy((F.floor(F.col(axis) / width)).cast("bigint").alias("bucket")).agg(*aggs)


def rolling(df: DataFrame, agg: Column, name: str, before: int, axis: str = "i0", by: tuple[str, ...] = (), block: int = 1 << 16) -> DataFrame:
    """An aggregate over each place and the rows before it, by ROWS of a dense axis.

    The axis is cut into blocks; the last rows of a block are also sent to the next ones as a halo, so no task gets the whole axis.
    """
    block = max(block, before)
    own = F.floor(F.col(axis) / block).cast("bigint")
    spread = df.withColumn("__own", own).withColumn("__b", F.explode(F.array_distinct(F.array(own, F.floor((F.col(axis) + before) / block).cast("bigint")))))
    w = W.partitionBy(*by, "__b").orderBy(axis).rowsBetween(-before, 0)
    return spread.withColumn(name, agg.over(w)).where("__b = __own").drop("__own", "__b")


def strided(df: DataFrame, steps: dict[str, tuple[int, int]]) -> DataFrame:
    """Every step-th place from a start, by axis."""
    for axis, (start, step) in steps.items():
        df = df.where((F.col(axis) >= start) & ((F.col(axis) - start) % step == 0))
    return df


def points(df: DataFrame, places: DataFrame, on: tuple[str, ...] = ("i0",)) -> DataFrame:
    """The elements at the places of a table."""
    return df.join(places.select(*on).distinct(), list(on), "left_semi")


def head(df: DataFrame, n: int = 10, ndim: int = 1) -> DataFrame:
    """The first n elements in row-major order."""
    return df.orderBy(*(f"i{d}" for d in range(ndim))).limit(n)


def num_elements(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def position(shape: list[int]) -> Column:
    """The row-major position of a row with index columns."""
    out, n = F.lit(0).cast("bigint"), 1
    for d in range(len(shape) - 1, -1, -1):
        out = out + F.col(f"i{d}") * n
        n *= shape[d]
    return out


def chunk_counts(shape: Column, chunk: Column) -> Column:
    return F.zip_with(shape, chunk, lambda n, c: F.ceil(n / c).cast("bigint"))


def offsets_for_index(i: Column, grid: Column, chunk: Column) -> Column:
    """Element offsets of the i-th chunk: index arithmetic from the last dimension to the first."""
    start = F.struct(i.cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct(F.floor(a["rest"] / x["g"]).cast("bigint").alias("rest"), F.concat(F.array((a["rest"] % x["g"]) * x["c"]), a["out"]).alias("out"))
    pairs = F.reverse(F.zip_with(grid, chunk, lambda g, c: F.struct(g.alias("g"), c.alias("c"))))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def chunk_grid(datasets: DataFrame) -> DataFrame:
    """path, chunk_no, offsets: all cells of each chunked dataset, stored or not."""
    grid = datasets.where("layout = 'Chunked'").withColumn("grid", chunk_counts(F.col("shape"), F.col("chunk_shape")))
    cells = grid.withColumn("n", num_elements(F.col("grid"))).where("n > 0").withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return cells.select("path", "chunk_no", offsets_for_index(F.col("chunk_no"), F.col("grid"), F.col("chunk_shape")).alias("offsets"))


def touched(chunks: DataFrame, chunk_shape: list[int], selections: DataFrame, ndim: int) -> DataFrame:
    """(selection, chunk) pairs whose boxes overlap; selections: id, and lo and hi arrays.

    Each selection is first spread over the cells of the first axis, so the join is an equi-join on that cell.
    """
    c = chunks.withColumn("cell", F.floor(F.col("offsets")[0] / chunk_shape[0]).cast("bigint"))
    s = selections.where(reduce(lambda a, b: a & b, [F.col("lo")[d] < F.col("hi")[d] for d in range(ndim)]))
    first, last = F.floor(F.col("lo")[0] / chunk_shape[0]), F.floor((F.col("hi")[0] - 1) / chunk_shape[0])
    s = s.withColumn("cell", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    rest = [(F.col("offsets")[d] < F.col("hi")[d]) & (F.col("offsets")[d] + chunk_shape[d] > F.col("lo")[d]) for d in range(ndim)]
    return c.join(s, "cell").where(reduce(lambda a, b: a & b, rest)).drop("cell")


def asof(left: DataFrame, right: DataFrame, key: str, on: str) -> DataFrame:
    """left rows with the other columns of the right row of their key that has the largest on not above theirs; nulls if there is none.

    One shuffle by key: right rows are merged among left rows and carried forward.
    """
    carried = [c for c in right.columns if c not in (key, on)]
    r = right.select(key, on, F.struct(*carried).alias("__r"), F.lit(0).alias("__side"))
    both = left.withColumn("__l", F.struct(*left.columns)).select(key, on, "__l", F.lit(1).alias("__side")).unionByName(r, allowMissingColumns=True)
    order = W.partitionBy(key).orderBy(on, "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in carried))
