"""Statistics of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import roots, windows
from .links import children


def coverage_histogram(nodes: DataFrame) -> DataFrame:
    """A3: (coverage, n) over all nodes, the two of k = 1 at coverage 0."""
    return roots(nodes).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


def coverage_totals(nodes: DataFrame) -> DataFrame:
    """A3: (n, total, highest, average), the average in whole numbers."""
    return roots(nodes).agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("total"), F.max("coverage").alias("highest")).withColumn("average", F.expr("total div n"))


def log_statistics(nodes: DataFrame) -> DataFrame:
    """A4: (k, bin, n, total, highest) by floor of log2 of the coverage."""
    return nodes.where("k > 1").groupBy("k", S.log2_floor("coverage").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("total"), F.max("coverage").alias("highest"))


def log_totals(nodes: DataFrame) -> DataFrame:
    """A4: (k, n, total, highest, average) for each k and, as k = 0, over all."""
    rows = nodes.where("k > 1").rollup("k").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("total"), F.max("coverage").alias("highest"))
    return rows.withColumn("average", F.expr("total div n")).withColumn("k", F.coalesce("k", F.lit(0).cast("long")))


def log_mass_hook(nodes: DataFrame) -> DataFrame:
    """A5: (k, hook): the bin of at least 1 with the largest floor(log2(n)) * bin, the first of equals; 0 without one."""
    bins = log_statistics(nodes).select("k", "bin", (S.log2_floor("n") * F.col("bin")).alias("score"))
    best = bins.groupBy("k").agg(F.max(F.when(F.col("bin") >= 1, F.struct("score", (-F.col("bin")).alias("b")))).alias("m"))
    return best.select("k", F.coalesce(-F.col("m.b"), F.lit(0)).cast("long").alias("hook"))


def adjacent_pairs(nodes: DataFrame) -> DataFrame:
    """(k, a, b, times): coverages of neighbouring windows of size k in the reads.

    Two neighbouring windows are the prefix and the suffix of a (k + 1)-mer, so the node table alone has
    how often each pair stands in the reads; no read is touched and nothing is ordered.
    """
    top = nodes.where("k > 2").select((F.col("k") - 1).alias("k"), S.canonical(F.left("kmer", F.col("k") - 1)).alias("x"), S.canonical(F.right("kmer", F.col("k") - 1)).alias("y"), F.col("coverage").alias("times"))
    side = nodes.select("k", "kmer", "coverage")
    with_a = top.join(side.select("k", F.col("kmer").alias("x"), F.col("coverage").alias("a")), ["k", "x"])
    return with_a.join(side.select("k", F.col("kmer").alias("y"), F.col("coverage").alias("b")), ["k", "y"]).select("k", "a", "b", "times")


def _permille(pairs: DataFrame) -> DataFrame:
    """floor(1000 |a - b| / max(a, b)) in whole numbers."""
    return pairs.withColumn("bin", F.expr("(1000 * abs(a - b)) div greatest(a, b)"))


def read_link_histogram(nodes: DataFrame) -> DataFrame:
    """(k, bin, n): neighbouring windows by their relative difference in thousandths."""
    return _permille(adjacent_pairs(nodes)).groupBy("k", "bin").agg(F.sum("times").alias("n"))


def read_link_statistics(nodes: DataFrame) -> DataFrame:
    """(k, n, mean, variance, zero_variance) of the differences below 0.9."""
    d = F.abs(F.col("a") - F.col("b")).cast("double") / F.greatest("a", "b")
    near = adjacent_pairs(nodes).where("10 * abs(a - b) < 9 * greatest(a, b)").withColumn("d", d)
    sums = near.groupBy("k").agg(F.sum("times").alias("n"), F.sum(F.col("d") * F.col("times")).alias("s"), F.sum(F.col("d") * F.col("d") * F.col("times")).alias("ss"))
    return sums.select("k", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.col("n"), 6).alias("variance"), F.round(F.col("ss") / F.col("n"), 6).alias("zero_variance"))


def child_statistics(nodes: DataFrame) -> DataFrame:
    """(k, n_children, n): nodes by the number of their children, 0 to 8."""
    per = children(nodes).groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.select("k", "kmer").join(per, ["k", "kmer"], "left").groupBy("k", F.coalesce("n_children", F.lit(0)).alias("n_children")).agg(F.count(F.lit(1)).alias("n"))


def child_summary(nodes: DataFrame) -> DataFrame:
    """(k, average, share_up_to_2) of child_statistics."""
    return child_statistics(nodes).groupBy("k").agg(
        F.round(F.sum(F.col("n") * F.col("n_children")) / F.sum("n"), 6).alias("average"),
        F.round(F.sum(F.when(F.col("n_children") <= 2, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_up_to_2"),
    )


def reference_comparison(nodes: DataFrame, references: DataFrame, ks: list[int]) -> DataFrame:
    """references(ref_id, seq) -> for each reference and k: nodes and coverage that agree, disagree, in percent.

    Disagreement is the total of k less the agreement, so references never meet nodes that they don't share.
    """
    marks = windows(references.select(F.col("ref_id").alias("read_id"), "seq"), ks).select(F.col("read_id").alias("ref_id"), F.col("k").cast("long"), "kmer").distinct()
    agree = marks.join(nodes.select("k", "kmer", "coverage"), ["k", "kmer"]).groupBy("ref_id", "k").agg(F.count(F.lit(1)).alias("nodes_agree"), F.sum("coverage").alias("mass_agree"))
    totals = nodes.groupBy("k").agg(F.count(F.lit(1)).alias("all_nodes"), F.sum("coverage").alias("all_mass"))
    grid = references.select("ref_id").distinct().withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    rows = grid.join(totals, "k").join(agree, ["ref_id", "k"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    rows = rows.select("ref_id", "k", zero("nodes_agree").alias("nodes_agree"), (F.col("all_nodes") - zero("nodes_agree")).alias("nodes_disagree"), zero("mass_agree").alias("mass_agree"), (F.col("all_mass") - zero("mass_agree")).alias("mass_disagree"))
    return rows.withColumn("nodes_percent", F.round(S.percent("nodes_agree", "nodes_disagree"), 6)).withColumn("mass_percent", F.round(S.percent("mass_agree", "mass_disagree"), 6))


def reference_agreement(nodes: DataFrame, references: DataFrame, ks: list[int], agree: bool = True) -> DataFrame:
    """The nodes that occur (or don't) in any reference."""
    marks = windows(references.select(F.col("ref_id").alias("read_id"), "seq"), ks).select(F.col("k").cast("long"), "kmer")
    return nodes.join(marks, ["k", "kmer"], "left_semi" if agree else "left_anti")
