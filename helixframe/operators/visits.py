"""Hooks: one's own function over k-mers, nodes and links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import adjacency
from .components import connected_components
from .kmers import windows


def visit_kmers(reads: DataFrame, ks: list[int], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, nodes: DataFrame | None = None) -> DataFrame:
    """Function over Arrow batches of (read_id, k, pos, kmer[, coverage]); with nodes (G6) windows that are none are left out."""
    rows = windows(reads, ks)
    if nodes is not None:
        rows = rows.withColumn("k", F.col("k").cast("long")).join(nodes.select("k", "kmer", "coverage"), ["k", "kmer"]).select("read_id", "k", "pos", "kmer", "coverage")
    return rows.mapInArrow(function, schema)


def unbroken_windows(reads: DataFrame, ks: list[int], nodes: DataFrame) -> DataFrame:
    """(read_id, k, pos, kmer) of windows that are nodes(k, kmer) and hold no shorter window of ks that is none.

    A read is in effect split wherever a k-mer is missing, and longer windows never cross the gap: a
    window stays if it ends before the first end of a missing window that starts at its place or later.
    One pass over each read's windows, whatever the number of gaps.
    """
    rows = windows(reads, ks).withColumn("k", F.col("k").cast("long"))
    marked = rows.join(nodes.select("k", "kmer", F.lit(True).alias("there")), ["k", "kmer"], "left")
    later = W.partitionBy("read_id").orderBy("pos").rangeBetween(W.currentRow, W.unboundedFollowing)
    gap = F.min(F.when(F.col("there").isNull(), F.col("pos") + F.col("k"))).over(later)
    return marked.withColumn("gap", gap).where("gap IS NULL OR gap > pos + k").select("read_id", "k", "pos", "kmer")


def visit_unbroken(reads: DataFrame, ks: list[int], nodes: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Function over Arrow batches of unbroken_windows."""
    return unbroken_windows(reads, ks, nodes).mapInArrow(function, schema)


def fold_nodes(nodes: DataFrame, *aggregates: Column, by_k: bool = True) -> DataFrame:
    """Aggregates over all nodes, by k or in all."""
    rows = nodes.where((F.col("coverage") > 0) | (F.col("k") == 1))
    return (rows.groupBy("k") if by_k else rows).agg(*aggregates)


def group_by_links(nodes: DataFrame, min_k: int, joined: Column) -> DataFrame:
    """(node, component) over the links for which the condition on (src, dst, strength) holds."""
    return connected_components(adjacency(nodes, min_k).where(joined))
