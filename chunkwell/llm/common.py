"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that is not a digit, an ASCII letter or a non-ASCII character separates words.
WORD_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chunkwell-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_SCOPES: list[list[str]] = []


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted at the end of the scope it was made in, or else when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
        return path

    def last() -> None:
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already at exit
            pass

    atexit.register(last)
    return path


def settled(spark: SparkSession, name: str, make) -> DataFrame:
    """make()'s result as a table of the shared folder; the tables that make() wrote on the way are deleted."""
    path = scratch_path(spark, name)
    _SCOPES.append([])
    try:
        out = make()
        out.write.parquet(path)
    finally:
        for p in _SCOPES.pop():
            drop(spark, p)
    return spark.read.schema(out.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """A table of ids or pairs of ids, marked for a broadcast if it has at most BROADCAST_IDS rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever those are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_SEPARATOR)
    # only the first and the last part can be empty
    return F.filter(parts, lambda x: x != "")


def id_bucket(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, mod parts; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def id_bucket_col(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hash_share(id_col: str, rows: int, most: int, seed: int = 0) -> Column:
    """A filter by a hash of the id that keeps about 2 * most of rows rows, so that picking the first most of them by that hash
    never gathers more than a bounded number, whatever the number of partitions."""
    share = 1.0 if rows <= 2 * most else 2 * most / rows
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1


def hash_sample(df: DataFrame, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """At most most rows, those with the smallest hashes of their ids among about twice as many: a bounded training sample."""
    kept = df.where(hash_share(id_col, df.count(), most, seed))
    return kept.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(most)


def release() -> None:
    """Gives memory that Python no longer uses back to the system: workers are reused, so what one stage has freed would count
    against the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, *caches):
    """A function of batches that empties its caches and gives memory back when a task ends.  caches: functions that return one."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c().clear()
            release()

    return go
