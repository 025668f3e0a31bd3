"""Helpers of the training-data operators: column picking, the shared folder, files in any store."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.session import fresh_path


def only(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns (`new=old` renames), found by exact name.

    All other columns are left behind, so extra columns with any name, also one
    that differs by case only or stands twice, cannot clash with an operator's
    own. Of several columns of one name the first counts.
    """
    have = df.columns
    wanted = {n: n for n in names} | renamed
    missing = [old for old in wanted.values() if old not in have]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {have}")
    return df.toDF(*[f"c{i}" for i in range(len(have))]).select(*[F.col(f"c{have.index(old)}").alias(new) for new, old in wanted.items()])


def keep_table(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it again: cuts lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(path: str):
    """(file system, path in it) of a path or URI, for use inside tasks."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def map_rows(df: DataFrame, per_batch: Callable[..., dict], schema: str) -> DataFrame:
    """Apply `per_batch(**columns as lists) -> columns as lists or arrays` to Arrow batches, a slice at a time."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = per_batch(**{n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)
            del batch, made
        give_back()
    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, one row at least: Python objects made from a batch are many times its size."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def give_back() -> None:
    """Return the memory that a task's arrays have freed to the system, as Spark keeps its workers for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if trim is not None:
        trim(0)
