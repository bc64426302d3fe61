"""Parquet tables as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 32 << 20


def read_table(spark: SparkSession, path: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """A Parquet table; a single file of at most small_bytes is dealt out over all cores.

    Such a file often is one row group, which one task reads while the others wait.  The size is that of
    the files, known before anything is read; larger tables are never shuffled here.
    """
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = 1 << 20 < size <= small_bytes and len(df.inputFiles()) == 1
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df
