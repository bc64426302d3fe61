"""Links between nodes as equi-joins on (k, kmer): parents, children, neighbours, advance, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import oriented


def parent_keys(nodes: DataFrame) -> DataFrame:
    """(k, kmer, side, parent, reversed): side 0 drops the first base, 1 the last; reversed if the parent is stored on the other strand."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.right("kmer", F.col("k") - 1).alias("p")), F.struct(F.lit(1).alias("side"), F.left("kmer", F.col("k") - 1).alias("p")))
    rows = nodes.where("k > 1").select("k", "kmer", F.explode(sides).alias("s")).select("k", "kmer", "s.side", "s.p")
    return rows.select("k", "kmer", "side", S.canonical("p").alias("parent"), (F.col("p") > S.revcomp("p")).alias("reversed"))


def parents(nodes: DataFrame) -> DataFrame:
    """parent_keys of parents that exist, with both coverages."""
    up = nodes.select((F.col("k") + 1).alias("k"), F.col("kmer").alias("parent"), F.col("coverage").alias("parent_coverage"))
    own = nodes.select("k", "kmer", "coverage")
    return parent_keys(nodes).join(up, ["k", "parent"]).join(own, ["k", "kmer"]).select("k", "kmer", "side", "parent", "reversed", "coverage", "parent_coverage")


def children(nodes: DataFrame) -> DataFrame:
    """(k, kmer, dir, base, child, child_coverage): one-base extensions that are nodes; dir 1 extends the reverse complement."""
    down = oriented(nodes.select("k", "kmer", "coverage")).where("k > 1")
    down = down.select((F.col("k") - 1).alias("k"), F.left("w", F.col("k") - 1).alias("p"), F.right("w", F.lit(1)).alias("base"), F.col("kmer").alias("child"), F.col("coverage").alias("child_coverage"))
    rc = S.revcomp("p")
    dirs = F.when(F.col("p") == rc, F.array(F.lit(0), F.lit(1))).when(F.col("p") < rc, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    keyed = down.withColumn("kmer", S.canonical("p")).withColumn("dir", F.explode(dirs))
    return keyed.join(nodes.select("k", "kmer"), ["k", "kmer"]).select("k", "kmer", "dir", "base", "child", "child_coverage")


def neighbours(nodes: DataFrame) -> DataFrame:
    """(k, kmer, w, base, neighbour, neighbour_coverage): w without its first base plus base is a node too."""
    left = oriented(nodes.select("k", "kmer")).select("k", "kmer", "w", F.right("w", F.col("k") - 1).alias("core")).where("k > 1")
    right = oriented(nodes.select("k", "kmer", "coverage")).select("k", F.col("kmer").alias("neighbour"), F.left("w", F.col("k") - 1).alias("core"), F.right("w", F.lit(1)).alias("base"), F.col("coverage").alias("neighbour_coverage"))
    return left.join(right, ["k", "core"]).select("k", "kmer", "w", "base", "neighbour", "neighbour_coverage")


def advance(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """at(w, base) -> (w, base, k, kmer): the longest suffix of w + base that is a node."""
    ends = at.select("w", "base").distinct().withColumn("whole", F.concat("w", "base")).withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), F.length("whole").cast("long"))))
    found = ends.withColumn("kmer", S.canonical(F.right("whole", F.col("k").cast("int")))).join(nodes.select("k", "kmer"), ["k", "kmer"])
    return found.groupBy("w", "base").agg(F.max(F.struct("k", "kmer")).alias("m")).select("w", "base", "m.k", "m.kmer")


def find(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """sequences(seq) -> (seq, k, kmer, coverage); coverage is null where the sequence is no node."""
    asked = sequences.select("seq").distinct().select("seq", F.length("seq").cast("long").alias("k"), S.canonical("seq").alias("kmer"))
    return asked.join(nodes.select("k", "kmer", "coverage"), ["k", "kmer"], "left").select("seq", "k", "kmer", "coverage")


def surface(nodes: DataFrame) -> DataFrame:
    """T4: nodes without children."""
    return nodes.join(parent_keys(nodes).select((F.col("k") - 1).alias("k"), F.col("parent").alias("kmer")), ["k", "kmer"], "left_anti")


def redundant(nodes: DataFrame) -> DataFrame:
    """Nodes without children, neither of whose parents has another child on that side."""
    slots = children(nodes).select("k", "kmer", "dir", "child").distinct().groupBy("k", "kmer", "dir").agg(F.count(F.lit(1)).alias("n"))
    crowded = slots.where("n > 1").join(children(nodes).select("k", "kmer", "dir", "child"), ["k", "kmer", "dir"]).select((F.col("k") + 1).alias("k"), F.col("child").alias("kmer"))
    return surface(nodes).join(crowded, ["k", "kmer"], "left_anti")


def coverage_unambiguous(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes with at most one child on each side whose squared link strength is below threshold."""
    near = children(nodes).join(nodes.select("k", "kmer", "coverage"), ["k", "kmer"]).where(F.pow(S.link_strength("coverage", "child_coverage"), 2) < threshold)
    many = near.groupBy("k", "kmer", "dir").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(many, ["k", "kmer"], "left_anti")


def shared_links(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Pruned nodes both of whose parents stay: (k, kmer, coverage, suffix_parent, prefix_parent)."""
    gone = nodes.join(kept.select("k", "kmer"), ["k", "kmer"], "left_anti").where("k > 1")
    keys = gone.select("k", "kmer", "coverage", S.canonical(F.right("kmer", F.col("k") - 1)).alias("suffix_parent"), S.canonical(F.left("kmer", F.col("k") - 1)).alias("prefix_parent"))
    stays = kept.select((F.col("k") + 1).alias("k"), F.col("kmer"))
    for side in ("suffix_parent", "prefix_parent"):
        keys = keys.join(stays.withColumnRenamed("kmer", side), ["k", side], "left_semi")
    return keys.select("k", "kmer", "coverage", "suffix_parent", "prefix_parent")
