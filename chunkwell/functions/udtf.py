"""SQL functions: the catalog as a table function, and string and filter helpers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="path string, shape array<bigint>, layout string, element_bytes int, filters array<string>")
class Hdf5Datasets:
    """SELECT * FROM hdf5_datasets('file.h5')"""

    def eval(self, path: str) -> Iterator[tuple]:
        from chunkwell.fmt.file import H5File

        with H5File(path) as f:
            for d in f.datasets():
                yield d.path, list(d.shape), d.layout.kind, d.dtype_info[2], d.filter_names


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("hdf5_datasets", Hdf5Datasets)
