"""Reads: trimming, filtering, routing, duplicate pairs, quality joins.

A read is a row (read_id, seq[, qual]); a pair is (pair_id, s1, s2[, q1, q2]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(seq: Column, qual: Column | None, trim_n: bool, trim_q: int | None) -> Column:
    """Struct (first, size) of what trimming keeps, by 1-based position."""
    n = F.length(seq)
    base_ok = (lambda i: F.substring(seq, i, 1) != "N") if trim_n else (lambda i: F.lit(True))
    if qual is None or trim_q is None:
        ok = base_ok
    else:
        ok = lambda i: base_ok(i) & (F.ascii(F.substring(qual, i, 1)) > trim_q)
    good = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ok(i))
    return F.struct(F.coalesce(F.array_min(good), F.lit(1)).alias("first"), F.coalesce(F.array_max(good) - F.array_min(good) + 1, F.lit(0)).alias("size"))


def trim_n(seq: Column | str) -> Column:
    """T1 without qualities: strip N at both ends."""
    return F.regexp_replace(seq, "^N+|N+$", "")


def trim(reads: DataFrame, n: bool = True, quality: int | str | None = None, seq: str = "seq", qual: str | None = "qual") -> DataFrame:
    """From either end drop bases that are N (if n) or of quality at most ``quality`` (number or character).

    Reads without a quality of their own length are trimmed of N alone.
    """
    cut = ord(quality) if isinstance(quality, str) else quality
    has_qual = qual is not None and qual in reads.columns
    plain = trim_n(F.col(seq)) if n else F.col(seq)
    if not has_qual or cut is None:
        if not has_qual or not n:
            return reads.withColumn(seq, plain)
        cut = -1
    keep = F.when(F.length(qual) == F.length(seq), _bounds(F.col(seq), F.col(qual), n, cut))
    out = reads.withColumn("__keep", keep)
    out = out.withColumn(qual, F.when(F.col("__keep").isNotNull(), F.substring(F.col(qual), F.col("__keep.first"), F.col("__keep.size"))).otherwise(F.col(qual)))
    return out.withColumn(seq, F.when(F.col("__keep").isNotNull(), F.substring(F.col(seq), F.col("__keep.first"), F.col("__keep.size"))).otherwise(plain)).drop("__keep")


def longer_than(reads: DataFrame, min_k: int, seq: str = "seq") -> DataFrame:
    """Reads of more than min_k bases."""
    return reads.where(F.length(seq) > min_k)


def discarded_reads(reads: DataFrame, min_k: int, seq: str = "seq") -> DataFrame:
    """A10: (n_kept, n_discarded) of longer_than."""
    return reads.agg(F.count_if(F.length(seq) > min_k).alias("n_kept"), F.count_if(F.coalesce(F.length(seq), F.lit(0)) <= min_k).alias("n_discarded"))


def pair_reads(first: DataFrame, second: DataFrame, key: str = "read_id") -> DataFrame:
    """Mates of equal key as (pair_id, s1, s2), the smaller mate first."""
    pairs = first.select(key, F.col("seq").alias("a")).join(second.select(key, F.col("seq").alias("b")), key)
    return pairs.select(F.col(key).alias("pair_id"), F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2"))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """One row (pair_id, s1, s2, dupecount) for each unordered pair; pair_id is the smallest."""
    return pairs.groupBy(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).agg(F.min("pair_id").alias("pair_id"), F.count(F.lit(1)).alias("dupecount")).select("pair_id", "s1", "s2", "dupecount")


def unique_pairs_quality(pairs: DataFrame, adjust: int = 33, cap: int = 126) -> DataFrame:
    """D1 with D3: pairs(pair_id, s1, s2, q1, q2) once each, with the qualities of duplicates joined mate by mate."""
    once = unique_pairs(pairs)
    turned = F.col("s1") > F.col("s2")
    straight = pairs.select("pair_id", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), F.when(turned, F.col("q2")).otherwise(F.col("q1")).alias("q1"), F.when(turned, F.col("q1")).otherwise(F.col("q2")).alias("q2"))
    for s, q in (("s1", "q1"), ("s2", "q2")):
        mates = straight.select(F.col("pair_id").alias("read_id"), F.col(s).alias("own"), F.concat_ws("/", "s1", "s2").alias("seq"), F.col(q).alias("qual")).where(F.length("own") == F.length(q))
        added = _added_quality(mates, adjust, cap).select(F.col("seq").alias("both"), F.col("qual").alias(q))
        once = once.join(added, F.concat_ws("/", "s1", "s2") == F.col("both"), "left").drop("both")
    return once.withColumn("q1", F.coalesce("q1", F.lit(""))).withColumn("q2", F.coalesce("q2", F.lit("")))


def joined_quality(reads: DataFrame, adjust: int = 33, cap: int = 126) -> DataFrame:
    """D3: reads(read_id, seq, qual) of equal seq and quality length as one, quality q1 + q2 - adjust, at most cap.

    Added position by position before the shuffle: as every step only adds a number of at least zero for
    qualities from adjust up, the capped sum does not depend on the order.
    """
    return _added_quality(reads.where(F.length("seq") == F.length("qual")), adjust, cap)


def _added_quality(reads: DataFrame, adjust: int, cap: int) -> DataFrame:
    points = reads.select("read_id", "seq", F.posexplode(F.split("qual", "")).alias("at", "c"))
    added = points.groupBy("seq", "at").agg(F.sum(F.ascii("c") - adjust).alias("q"), F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("n"))
    whole = added.groupBy("seq").agg(
        F.min("read_id").alias("read_id"),
        F.max("n").alias("dupecount"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "q"))), lambda x: F.chr(F.least(F.lit(cap), x["q"] + adjust).cast("int"))), "").alias("qual"),
    )
    return whole.select("read_id", "seq", "qual", "dupecount")


def route_pairs(pairs: DataFrame, min_length: int | None = None, n: bool = True) -> DataFrame:
    """K6: mates trimmed and routed: (pair_id, mate, seq, kept); min_length is half the original by default."""
    mates = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("s1").alias("raw")), F.struct(F.lit(2).alias("mate"), F.col("s2").alias("raw")))).alias("m")).select("pair_id", "m.*")
    trimmed = mates.withColumn("seq", trim_n("raw") if n else F.col("raw"))
    least = F.lit(min_length) if min_length is not None else F.floor(F.length("raw") / 2)
    return trimmed.select("pair_id", "mate", "seq", (F.length("seq") >= least).alias("kept"))
