"""Incremental k-mer counts (S9, 2.13): counts are sums, so a stream ends where a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kmers import windows


def read_stream(spark: SparkSession, path: str, schema: str = "read_id long, seq string", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def count_stream(reads: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """(k, kmer, coverage) of a stream of reads(seq); the state is one row for each k-mer (update or complete mode)."""
    found = windows(reads.select(F.lit(0).alias("read_id"), "seq"), list(range(min_k, max_k + 1)))
    return found.groupBy(F.col("k").cast("long").alias("k"), "kmer").agg(F.count(F.lit(1)).alias("coverage"))
