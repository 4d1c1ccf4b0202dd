"""Stages parquet columns as HDF5 files for the queries: once for each folder of tables, in a temporary folder."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .h5writer import Writer
from .spread import Spread, save

_HOME: list[str] = []


def home(spark: SparkSession) -> str:
    """In the shared folder if that is a local path, else in a folder of this machine (local mode)."""
    if not _HOME:
        shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        mounted = shared.startswith("/") and os.path.isdir(shared)
        if not mounted and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a mounted folder that all executors share")
        _HOME.append(tempfile.mkdtemp(prefix="chunkwell-h5-", dir=shared if mounted else None))
        atexit.register(shutil.rmtree, _HOME[0], True)
    return _HOME[0]


def column(spark: SparkSession, sf_dir: str, table: str, order: str, *names: str):
    """Columns of a table in the order of a key, as Arrow on the driver: for region and nation, which do not grow."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(order, *[n for n in names if n != order]).orderBy(order).toArrow()


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Writer]) -> str:
    path = f"{home(spark)}/{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}-{name}.h5"
    if not os.path.exists(path):
        build().save(path + ".part")
        os.replace(path + ".part", path)
    return path


def spread(spark: SparkSession, sf_dir: str, name: str, table: str | DataFrame, key: str, datasets: dict[str, Spread], writer: Callable[[], Writer] = Writer, by_key: bool = False) -> str:
    """The same for columns that may be large: written by tasks, beside what the writer holds already."""
    path = f"{home(spark)}/{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}-{name}.h5"
    if not os.path.exists(path):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet") if isinstance(table, str) else table
        save(writer(), path + ".part", df, key, datasets, by_key)
        os.replace(path + ".part", path)
    return path
