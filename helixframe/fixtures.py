"""Reads, references, pairs and qualities made from the driver's tables: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import seq as S
from .sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (read_id, seq)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), S.project_text("text").alias("seq"))


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the reference encoding of their own letters; anything outside ASCII counts as one base."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), S.normalise("text").alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as (ref_id, seq)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), S.project_text("text").alias("seq"))


def reference_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).withColumnRenamed("ref_id", "read_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as (pair_id, s1, s2)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.project_text("text").alias("s1"))
    order = W.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("s2", F.lead("s1").over(order)).where("s2 IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "s1", "s2")


def quality_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by order as (read_id, seq, qual): return flags as bases, quantities as qualities."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(items.alias("x"))
    return rows.select(
        "read_id",
        F.array_join(F.transform("x", lambda i: i["l_returnflag"]), "").alias("seq"),
        F.array_join(F.transform("x", lambda i: F.chr((33 + i["l_quantity"]).cast("int"))), "").alias("qual"),
    )
