"""Variable-length strings as a join of references with heap objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..api import read


def little_endian(raw: Column, at: int, n: int) -> Column:
    """An unsigned number of n bytes, from byte at on, as BIGINT."""
    digits = [F.substring(raw, at + n - k, 1) for k in range(n)]
    return F.conv(F.concat(*(F.hex(d) for d in digits)), 16, 10).cast("decimal(20,0)").cast("bigint")


def references(spark, path: str, dataset: str, ndim: int = 1) -> DataFrame:
    """Index columns, length, address, object: the references of a variable-length dataset.  An undefined address is null."""
    raw = read(spark, path, "raw", dataset=dataset)
    cols = [f"i{d}" for d in range(ndim)]
    address = F.when(F.substring("value", 5, 8) != F.lit(b"\xff" * 8), little_endian(F.col("value"), 4, 8))
    return raw.select(*cols, little_endian(F.col("value"), 0, 4).alias("length"), address.alias("address"), (little_endian(F.col("value"), 12, 4) % 65536).alias("object"))


def heap_objects(addresses: DataFrame, path: str) -> DataFrame:
    """address, object, data: objects of the global heap collections at the addresses."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from chunkwell.fmt.heaps import collection
        from chunkwell.sources.bytesource import ByteSource

        source = ByteSource.open(path)
        for b in batches:
            for a in b.column(0).to_pylist():
                found = collection(source, a)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["address", "object", "data"])

    # few bytes name many: without a number of tasks, adaptive execution would read all collections in one
    tasks = 4 * addresses.sparkSession.sparkContext.defaultParallelism
    return addresses.select("address").where("address is not null and address <> 0").distinct().repartition(tasks, "address").mapInArrow(run, "address bigint, object bigint, data binary")


def strings(spark, path: str, dataset: str, ndim: int = 1) -> DataFrame:
    """Index columns and value.  Empty references give empty strings; a reference without its object is an error."""
    refs = references(spark, path, dataset, ndim)
    # adaptive execution takes the objects to be as small as their addresses, and would broadcast them
    found = refs.join(heap_objects(refs, path).hint("merge"), ["address", "object"], "left")
    empty = (F.col("length") == 0) | F.col("address").isNull() | (F.col("address") == 0)
    missing = F.raise_error(F.concat(F.lit("Corrupt: no object "), F.col("object"))).cast("string")
    value = F.when(empty, F.lit("")).when(F.col("data").isNull(), missing).otherwise(F.expr("decode(substring(data, 1, length), 'utf-8')"))
    return found.select(*(f"i{d}" for d in range(ndim)), value.alias("value"))
