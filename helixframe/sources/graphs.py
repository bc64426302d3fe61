"""Graphs and tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators.links import parent_keys

NODE_SCHEMA = "kmer string, coverage long, edges int, is_palindrome boolean, k long"


def save_graph(nodes: DataFrame, path: str) -> None:
    """K7: Parquet by k, so a later read of one k touches that k alone."""
    nodes.select("kmer", "coverage", "edges", "is_palindrome", "k").write.mode("overwrite").partitionBy("k").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """Nodes as saved; links are joins and need no rebuilding."""
    return spark.read.schema(NODE_SCHEMA).parquet(path).select("k", "kmer", "coverage", "edges", "is_palindrome")


def _tab(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)  # one row for each k


def log_table(log_statistics: DataFrame, bins: int = 32) -> DataFrame:
    """K8: (k, nodes, sum, average, bin 0 to bins - 1)."""
    wide = log_statistics.groupBy("k").pivot("bin", list(range(bins))).agg(F.sum("n")).na.fill(0)
    heads = log_statistics.groupBy("k").agg(F.sum("n").alias("nodes"), F.sum("total").alias("sum")).withColumn("average", F.expr("sum div nodes"))
    return heads.join(wide, "k").orderBy("k")


def link_table(statistics: DataFrame, histogram: DataFrame, bins: int = 1000) -> DataFrame:
    """K9: statistics by k and the histogram's bins."""
    wide = histogram.groupBy("k").pivot("bin", list(range(bins))).agg(F.sum("n")).na.fill(0)
    return statistics.join(wide, "k").orderBy("k")


def child_table(statistics: DataFrame, summary: DataFrame) -> DataFrame:
    """Nodes by number of children, average, share with up to two."""
    wide = statistics.groupBy("k").pivot("n_children", list(range(9))).agg(F.sum("n")).na.fill(0)
    return wide.join(summary, "k").orderBy("k")


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    _tab(rows, path)


def describe(nodes: DataFrame, k: int | None = None) -> DataFrame:
    """Nodes in readable form."""
    rows = nodes if k is None else nodes.where(F.col("k") == k)
    spell = lambda shift: F.array_join(F.filter(F.array(*[F.when(F.col("edges").bitwiseAND(F.lit(shift >> i)) > 0, c) for i, c in enumerate(S.BASES)]), lambda x: x.isNotNull()), "")
    return rows.select("k", "kmer", S.revcomp("kmer").alias("reverse_complement"), "coverage", spell(128).alias("forward"), spell(8).alias("reverse"), "is_palindrome")


def vertices(nodes: DataFrame) -> DataFrame:
    """(id, label, size, level, shape, share): share is the coverage's part, 0 to 1, of the highest at that k, for colours."""
    top = nodes.groupBy("k").agg(F.max("coverage").alias("top"))  # one row for each k
    shape = F.when(F.col("is_palindrome"), "cube").otherwise("sphere").alias("shape")
    name = F.concat_ws(":", F.lpad(F.col("k").cast("string"), 3, "0"), "kmer").alias("id")
    return nodes.join(top, "k").select(name, F.col("kmer").alias("label"), F.col("coverage").alias("size"), F.col("k").alias("level"), shape, (F.col("coverage") / F.col("top")).alias("share"))


def arcs(nodes: DataFrame) -> DataFrame:
    """(src, dst, side): from each node to its parents."""
    ids = lambda k, x: F.concat_ws(":", F.lpad(k.cast("string"), 3, "0"), x)
    return parent_keys(nodes).where("k > 2").select(ids(F.col("k"), F.col("kmer")).alias("src"), ids(F.col("k") - 1, F.col("parent")).alias("dst"), "side")


def save_picture(nodes: DataFrame, path: str) -> None:
    """Vertices and arcs as Parquet, for any viewer."""
    vertices(nodes).write.mode("overwrite").parquet(f"{path}/vertices")
    arcs(nodes).write.mode("overwrite").parquet(f"{path}/arcs")
