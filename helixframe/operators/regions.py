"""Walks over graphs beyond one task: the graph is dealt out by regions that no walk leaves.

A region is a component over what a step needs: a shared context, or a close pair of k-mers that overlap
by all but one base.  Walks in different regions never meet, so dealing by region changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.staging import drop, stage
from .components import connected_components
from .grouped import by_group

#: What one task may hold as a table of k-mers: rows, and bytes of k-mers.
MAX_NODES, MAX_BYTES = 2_000_000, 256 << 20


def held(nodes: DataFrame, value: str, max_nodes: int, max_bytes: int = MAX_BYTES) -> dict[str, int] | None:
    """K-mer -> value on the driver, or None if the table is beyond the bounds, which are checked first."""
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("kmer")), F.lit(0)).alias("b")).first()
    if size.n > max_nodes or size.b > max_bytes:
        return None
    return {r.kmer: r[value] for r in nodes.select("kmer", value).collect()}


def _items(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kmer, coverage): nodes, and seeds that aren't nodes, without coverage."""
    every = nodes.select("kmer", "coverage").unionByName(seeds.select(S.canonical("seq").alias("kmer"), F.lit(None).cast("long").alias("coverage")))
    return every.groupBy("kmer").agg(F.max("coverage").alias("coverage"))


def by_context(nodes: DataFrame, seeds: DataFrame, length: int) -> DataFrame:
    """(kmer, region): nodes and seeds that a chain of shared substrings of this length connects."""
    at = F.explode(F.sequence(F.lit(1), F.length("kmer") - length + 1))
    placed = _items(nodes, seeds).where(F.length("kmer") >= length).select("kmer", at.alias("p"))
    context = S.canonical(F.substring(F.col("kmer"), F.col("p"), F.lit(length)))
    return _named(placed.select(F.concat(F.lit("n"), "kmer").alias("src"), F.concat(F.lit("c"), context).alias("dst")).distinct())


def by_close_pairs(nodes: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """(kmer, region): k-mers of one k that a chain of overlaps by k - 1 bases connects, close in coverage.

    The bound is a little above the threshold, so that rounding can't part what a walk joins; seeds that
    aren't nodes are close to all.
    """
    n = F.length("kmer")
    cores = F.array_distinct(F.array(S.canonical(F.substring(F.col("kmer"), F.lit(1), n - 1)), S.canonical(F.substring(F.col("kmer"), F.lit(2), n - 1))))
    ends = stage(_items(nodes, seeds).where(n > 1).select("kmer", "coverage", F.explode(cores).alias("core")), "region-ends")
    other = ends.select(F.col("kmer").alias("next"), F.col("coverage").alias("c"), "core")
    close = F.col("coverage").isNull() | F.col("c").isNull() | (F.pow(S.link_strength("coverage", "c"), 2) < threshold * (1 + 1e-9) + 1e-12)
    pairs = ends.join(other, "core").where(F.col("kmer") < F.col("next")).where(close)  # a core has eight k-mers at most
    out = _named(pairs.select(F.concat(F.lit("n"), "kmer").alias("src"), F.concat(F.lit("n"), "next").alias("dst")).distinct())
    out = stage(out, "regions")
    drop(ends)
    return out


def _named(edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return found.where(F.col("node").startswith("n")).select(F.expr("substring(node, 2)").alias("kmer"), F.col("component").alias("region"))


def walk_regions(nodes: DataFrame, seeds: DataFrame, regions: DataFrame, max_nodes: int, function: Callable[[dict[str, int], list[str]], Iterable[tuple]], schema: str) -> DataFrame:
    """function(coverage by k-mer, seeds) -> rows, for each region; ValueError if one has over max_nodes nodes.

    A k-mer without a region is one of its own.
    """
    region = F.coalesce("region", "kmer").alias("region")
    own = nodes.select("kmer", "coverage").join(regions, "kmer", "left").select(region, "kmer", "coverage", F.lit(None).cast("string").alias("seed"))
    starts = seeds.select("seq", S.canonical("seq").alias("kmer")).join(regions, "kmer", "left").select(region, F.lit(None).cast("string").alias("kmer"), F.lit(None).cast("long").alias("coverage"), F.col("seq").alias("seed"))
    rows = stage(own.unionByName(starts), "region-rows")
    most = rows.groupBy("region").agg(F.count("kmer").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > max_nodes:
        raise ValueError(f"a region of the graph has {most} nodes, over {max_nodes}; prune the graph or raise max_nodes")

    def run(group: list):
        starts = [r.seed for r in group if r.seed is not None]
        if starts:
            yield from function({r.kmer: r.coverage for r in group if r.kmer is not None}, starts)

    return by_group(rows, "region", run, schema)
