"""The Python face of the engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.selection import bounds
from .sources.hdf5 import CATALOG, ArrayReader, CatalogReader, FilePart, Hdf5Source

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> SparkSession:
    """Makes format("hdf5") and the SQL functions known to a session, and allows the option pushdown=true."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Hdf5Source)
    from .functions.udtf import register_functions

    register_functions(spark)
    return spark


def read(spark: SparkSession, path: str, mode: str = "array", **options) -> DataFrame:
    reader = spark.read.format("hdf5").option("path", path).option("mode", mode)
    if mode not in CATALOG:
        options.setdefault("parallelism", spark.sparkContext.defaultParallelism)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()


def read_with_spark(spark: SparkSession, path: str, mode: str = "datasets", **options) -> DataFrame:
    """Whole files by Spark's own binary reader, one task each, for stores that only Spark reaches; files must fit in a task.

    The schema of array modes is that of the first file.
    """
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer().to_pybytes()
                if mode in CATALOG:
                    yield from CatalogReader(mode, options, []).read(FilePart(data))
                else:
                    reader = ArrayReader(mode, options, [data])
                    for part in reader.partitions():
                        yield from reader.read(part)

    schema = CATALOG.get(mode)
    if schema is None:
        first = bytes(files.first().content)
        source = Hdf5Source({**options, "mode": mode})
        source._files = lambda: [first]
        schema = source._columns(source._open())
    return files.mapInArrow(run, schema)


def where(spark: SparkSession, path: str, dataset: str, condition: str, mode: str = "array", **options) -> DataFrame:
    """The rows of a dataset that meet a SQL condition.  Its comparisons of index columns with numbers become the selection, so
    only chunks that it touches are read; the whole condition stays as a filter.

    This prunes without Spark's own pushdown to Python sources, which keeps the first pushed filters of a DataFrame for all
    later uses of it.  The option pushdown=true turns that on for DataFrames that are used once.
    """
    from .fmt.file import H5File
    from .sources.hdf5 import files_of

    found = bounds(condition)
    files = files_of(path)
    if found and "selection" not in options and len(files) == 1:
        with H5File(files[0]) as f:
            ds = f.dataset(dataset)
            if ds is not None and all(d < ds.ndim for d in found):
                options["selection"] = ",".join(f"{min(a, n)}:{max(min(a, n), min(z, n))}" for n, (a, z) in zip(ds.shape, (found.get(d, (0, n)) for d, n in enumerate(ds.shape)), strict=True))
    return read(spark, path, mode, dataset=dataset, **options).where(condition)


def list_datasets(spark: SparkSession, path: str, **options) -> DataFrame:
    """All datasets, by path within a file."""
    return read(spark, path, "datasets", **options)


def list_objects(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, path, "objects", **options)


def list_attributes(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, path, "attributes", **options)


def list_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, path, "chunks", **options)


def attr(spark: SparkSession, path: str, name: str, object: str = ""):
    """The first attribute of that name, as a value with as_str, as_strs, as_ints and as_floats; None if there is none."""
    from .fmt.file import H5File
    from .functions.attributes import decode
    from .sources.hdf5 import files_of

    with H5File(files_of(path)[0]) as f:
        found = next((a for a in f.attributes(object) or [] if a.name == name), None)
        return None if found is None else decode(f.source, found)


def io_stats(spark: SparkSession, path: str, dataset: str, **options) -> DataFrame:
    """What reading a dataset costs: requests and bytes of each partition."""
    return read(spark, path, "io", dataset=dataset, **options)


def open_dataset(spark: SparkSession, path: str, dataset: str, **options) -> DataFrame | None:
    """The dataset as a lazy DataFrame; None if there is no dataset at that path."""
    from .fmt.file import H5File
    from .sources.hdf5 import files_of

    with H5File(files_of(path)[0]) as f:
        if f.dataset(dataset) is None:
            return None
    return read(spark, path, dataset=dataset, **options)


def open_object(spark: SparkSession, path: str, name: str = "") -> DataFrame | None:
    """One row: kind, attributes and children of an object (no name: the root); None if it is not there."""
    from .fmt.file import H5File, hard_links
    from .sources.hdf5 import files_of

    with H5File(files_of(path)[0]) as f:
        at = f.navigate(name)
        if at is None:
            return None
        kind = "group" if hard_links(f.source, f.headers(at)) is not None else "dataset"
        children = [(c.name, c.kind) for c in f.children(at)]
    found = list_attributes(spark, path, object=name or "/")
    own = found.select(F.struct("name", "kind", "str", "strs", "ints", "floats", "raw").alias("a")).agg(F.collect_list("a").alias("attributes"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in children)) if children else F.array().cast("array<struct<name:string,kind:string>>")
    return own.select(F.lit(kind).alias("kind"), "attributes", names.alias("children"))


def read_full(spark: SparkSession, path: str, dataset: str, dtype: str | None = None, **options) -> DataFrame:
    return read(spark, path, dataset=dataset, **({"dtype": dtype} if dtype else {}), **options)


def read_range(spark: SparkSession, path: str, dataset: str, ranges, dtype: str | None = None, **options) -> DataFrame:
    """A hyperslab: one (start, end) for each dimension."""
    text = ",".join(f"{a}:{b}" for a, b in ranges)
    return read(spark, path, dataset=dataset, selection=text, **({"dtype": dtype} if dtype else {}), **options)


def read_range_bytes(spark: SparkSession, path: str, dataset: str, ranges) -> DataFrame:
    return read(spark, path, "raw", dataset=dataset, selection=",".join(f"{a}:{b}" for a, b in ranges))


def read_strings(spark: SparkSession, path: str, dataset: str) -> DataFrame | None:
    """All strings of a dataset; None if it does not hold strings."""
    from .fmt.file import H5File
    from .sources.hdf5 import files_of

    with H5File(files_of(path)[0]) as f:
        ds = f.dataset(dataset)
        if ds is None or ds.string_kind is None:
            return None
    return read(spark, path, dataset=dataset)


def to_numpy(df: DataFrame, ndim: int) -> np.ndarray:
    """The array of an array-mode DataFrame, on the driver, in row-major order; for results that fit there."""
    t = df.orderBy(*(f"i{d}" for d in range(ndim))).toArrow()
    coords = [t.column(f"i{d}").to_numpy() for d in range(ndim)]
    shape = [int(c.max() - c.min()) + 1 if len(c) else 0 for c in coords]
    return t.column("value").to_numpy(zero_copy_only=False).reshape(shape)
