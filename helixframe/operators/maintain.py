"""Graph maintenance: pruning, subtraction, marking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.staging import stage
from .links import parent_keys


def substrings(rows: DataFrame, min_length: int) -> DataFrame:
    """(k, kmer): distinct canonical substrings of rows' k-mers of min_length bases at least, themselves included."""
    sized = rows.select("kmer", S.revcomp("kmer").alias("rc"), F.length("kmer").alias("n")).where(F.col("n") >= min_length).withColumn("k", F.explode(F.sequence(F.lit(min_length), F.col("n"))))
    placed = sized.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1)))
    ahead, back = F.substring(F.col("kmer"), F.col("p"), F.col("k")), F.substring(F.col("rc"), F.col("n") - F.col("p") - F.col("k") + 2, F.col("k"))
    return placed.select(F.col("k").cast("long").alias("k"), F.least(ahead, back).alias("kmer")).distinct()


def clean(nodes: DataFrame, min_k: int) -> DataFrame:
    """nodes(k, kmer, coverage, edges, is_palindrome) without the redundant ones above min_k.

    A node above min_k stays if a parent is a palindrome or has more than one extension on a side, or if
    a node that stays contains it.  Staying is handed from child to both parents, so what stays is every
    substring above min_k of a seed: no iteration over levels.
    """
    telling = nodes.where(F.col("is_palindrome") | S.is_ambiguous("edges")).select((F.col("k") + 1).alias("k"), F.col("kmer").alias("parent"))
    seeds = parent_keys(nodes.where(F.col("k") > min_k)).join(telling, ["k", "parent"], "left_semi").select("k", "kmer").distinct()
    stay = substrings(seeds, min_k + 1)
    return nodes.where(F.col("k") <= min_k).unionByName(nodes.where(F.col("k") > min_k).join(stay, ["k", "kmer"], "left_semi"))


def refused_amounts(nodes: DataFrame, amounts: DataFrame) -> DataFrame:
    """C4: (k, kmer, amount, reason) of the amounts asked of palindromes, or over the node's coverage, or of no node."""
    asked = amounts.select("k", "kmer", F.col("amount").cast("long").alias("amount")).join(nodes.select("k", "kmer", "coverage"), ["k", "kmer"], "left")
    palindrome = S.is_palindrome("kmer")
    reason = F.when(F.col("coverage").isNull(), "no node").when(palindrome, "palindrome").when(F.col("amount") > F.col("coverage"), "coverage")
    return asked.select("k", "kmer", "amount", reason.alias("reason")).where("reason IS NOT NULL")


def subtract_coverage(nodes: DataFrame, amounts: DataFrame, floor_k: int = 1, refuse: bool = False) -> DataFrame:
    """C3, and with refuse C4, which leaves refused_amounts out: nodes(k, kmer, coverage) less amounts(k, kmer, amount), level by level from the longest k-mers.

    What is taken from a node is taken from both its parents too.  A node keeps at least the coverage of
    its children on either side, and at least zero.  Levels down to floor_k + 1 are visited; the number of
    levels is max_k, whatever the input's size.
    """
    top = nodes.agg(F.max("k")).first()[0]
    if refuse:
        amounts = amounts.join(refused_amounts(nodes, amounts).select("k", "kmer"), ["k", "kmer"], "left_anti")
    out, asked, kept = [], amounts.select("k", "kmer", F.col("amount").cast("long").alias("amount")), None
    for k in range(int(top or 0), floor_k, -1):
        level = nodes.where(F.col("k") == k).select("k", "kmer", "coverage")
        todo = asked.where(F.col("k") == k).groupBy("kmer").agg(F.sum("amount").alias("amount"))
        row = level.join(todo, "kmer", "left").withColumn("low", F.lit(0).cast("long"))
        if kept is not None:
            row = row.drop("low").join(_side_sums(kept, k), "kmer", "left").withColumn("low", F.coalesce("low", F.lit(0)))
        new = F.greatest(F.col("coverage") - F.coalesce("amount", F.lit(0)), F.least("low", "coverage"), F.lit(0))
        done = stage(row.select("k", "kmer", "coverage", new.alias("left")), f"subtract-{k}")
        out.append(done)
        passed = parent_keys(done.where("left < coverage")).join(done.withColumn("amount", F.col("coverage") - F.col("left")).select("kmer", "amount"), "kmer")
        asked = asked.where(F.col("k") < k).unionByName(passed.select((F.col("k") - 1).alias("k"), F.col("parent").alias("kmer"), "amount"))
        kept = done.select("k", "kmer", F.col("left").alias("coverage"))
    result = nodes.where(F.col("k") <= floor_k).select("k", "kmer", "coverage")
    for done in out:
        result = result.unionByName(done.select("k", "kmer", F.col("left").alias("coverage")))
    return result


def _side_sums(children_level: DataFrame, k: int) -> DataFrame:
    """(kmer, low): the larger of the coverages below a k-mer on its two sides; palindromes count one side."""
    from .kmers import oriented

    down = oriented(children_level).select(F.left("w", F.lit(k)).alias("p"), "coverage")
    sides = down.groupBy("p").agg(F.sum("coverage").alias("s"))
    return sides.groupBy(S.canonical("p").alias("kmer")).agg(F.max("s").alias("low"))


def deep_mark(nodes: DataFrame, marked: DataFrame, min_k: int = 2) -> DataFrame:
    """The nodes that marked k-mers contain, themselves included."""
    return nodes.join(substrings(marked, min_k), ["k", "kmer"], "left_semi")


def deep_mark_close(nodes: DataFrame, marked: DataFrame, threshold: float) -> DataFrame:
    """As deep_mark, going up only where the squared link strength to the parent is below threshold; stops at k = 2."""
    level = marked.select("k", "kmer").distinct()
    out, cov = level, nodes.select("k", "kmer", "coverage")
    while True:
        up = parent_keys(level.where("k > 2")).join(cov, ["k", "kmer"]).select((F.col("k") - 1).alias("k"), F.col("parent").alias("kmer"), F.col("coverage").alias("below"))
        level = stage(up.join(cov, ["k", "kmer"]).where(F.pow(S.link_strength("coverage", "below"), 2) < threshold).select("k", "kmer").distinct().join(out, ["k", "kmer"], "left_anti"), "mark")
        if level.isEmpty():
            return nodes.join(out, ["k", "kmer"], "left_semi")
        out = out.unionByName(level)
