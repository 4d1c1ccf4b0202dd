"""Structured Streaming over files that arrive in a folder, and windowed counts of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def catalog_stream(spark: SparkSession, folder: str) -> DataFrame:
    """file, path, elements: the datasets of each file as it arrives.  Only names go to the tasks; they read the metadata themselves."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from chunkwell.fmt.file import H5File

        for b in batches:
            for file in b.column(0).to_pylist():
                with H5File(file.replace("file:///", "/", 1) if file.startswith("file:/") else file) as f:
                    found = f.datasets()
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([d.path for d in found]), pa.array([d.space.elements for d in found], pa.int64())], ["file", "path", "elements"])

    arrivals = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.h5").load(folder)
    return arrivals.select("path").mapInArrow(run, "file string, path string, elements bigint")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by window and key, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts in overlapping windows; rows behind the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, step)).agg(F.count("*").alias("n"))


def running(events: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, high: count and largest value so far of each key, kept as state; a row for each key and batch that brings it."""
    kind = dict(events.dtypes)[by]

    def step(key, frames, state):
        n, high = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, high = n + len(f), max(high, float(f[value].max()))
        state.update((n, high))
        yield pd.DataFrame({by: [key[0]], "n": [n], "high": [high]})

    return events.select(by, value).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n bigint, high double", "n bigint, high double", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, then stops."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
