"""K-mers: windows, counts for a whole range of k, edge masks, nodes.

The node table has one row for each (k, canonical k-mer): coverage, edges (bit mask of one-base extensions
observed), is_palindrome.  Natural keys make compaction a matter of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S

MAX_K = 254


def check_range(min_k: int, max_k: int) -> None:
    if not 1 <= min_k <= max_k <= MAX_K:
        raise ValueError(f"need 1 <= min_k <= max_k <= {MAX_K}")


def pieces(reads: DataFrame, overlap: int, size: int = 64) -> DataFrame:
    """(read_id, offset, own, piece): reads in pieces of ``own`` bases that also hold the next ``overlap`` ones.

    A window then costs a short copy and a short scan, whatever the length of its read.
    """
    size = max(size, overlap)
    cut = reads.select("read_id", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("c"))
    parts = F.transform("c", lambda x, i: F.struct((i * size).alias("offset"), F.length(x).alias("own"), F.concat(x, F.left(F.coalesce(F.get("c", i + 1), F.lit("")), F.lit(overlap))).alias("piece")))
    return cut.select("read_id", F.explode(parts).alias("p")).select("read_id", "p.offset", "p.own", "p.piece")


def windows(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(read_id, k, pos, kmer): canonical k-mer at each 0-based position; a piece is reverse-complemented once."""
    rows = pieces(reads, max(ks) - 1).select("*", S.revcomp("piece").alias("rc"), F.length("piece").alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("k <= n")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.col("own") - 1, F.col("n") - F.col("k")))))
    ahead, back = F.substring(F.col("piece"), F.col("at") + 1, F.col("k")), F.substring(F.col("rc"), F.col("n") - F.col("at") - F.col("k") + 1, F.col("k"))
    return rows.select("read_id", "k", (F.col("offset") + F.col("at")).alias("pos"), F.least(ahead, back).alias("kmer"))


def longest_windows(reads: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """(w): what stands at each position, max_k bases or up to the end of the read, min_k at least."""
    parts = pieces(reads.select(F.lit(0).alias("read_id"), "seq"), max_k - 1).where(F.length("piece") >= min_k)
    at = F.explode(F.sequence(F.lit(1), F.least(F.col("own"), F.length("piece") - (min_k - 1))))
    return parts.select("piece", at.alias("at")).select(F.substring(F.col("piece"), F.col("at"), F.lit(max_k)).alias("w"))


def count_kmers(reads: DataFrame, min_k: int = 2, max_k: int = 12, preaggregate: bool = True) -> DataFrame:
    """A1: (k, kmer, coverage) for every k in [min_k, max_k].

    Every k-window is the prefix of the longest window at its place, so windows of max_k (shorter at the
    end of a read) are counted first, in the tasks and then over all, and each distinct one adds its count
    to its prefixes: one row is shuffled for each base read instead of max_k - min_k + 1, and the prefixes
    are made once for all reads that cover a place.  For small max_k the first count leaves 4 ** max_k rows
    at most, whatever the corpus' size.  preaggregate=False makes all prefixes from the reads directly.
    """
    check_range(min_k, max_k)
    longest = longest_windows(reads, min_k, max_k)
    counted = longest.groupBy("w").agg(F.count(F.lit(1)).alias("c")) if preaggregate else longest.withColumn("c", F.lit(1).cast("long"))
    both = counted.select("w", S.revcomp("w").alias("rc"), F.length("w").alias("n"), "c").withColumn("k", F.explode(F.sequence(F.lit(min_k), F.col("n"))))
    kmer = F.least(F.left("w", F.col("k")), F.right("rc", F.col("k")))
    return both.select(F.col("k").cast("long"), kmer.alias("kmer"), "c").groupBy("k", "kmer").agg(F.sum("c").alias("coverage"))


def oriented(nodes: DataFrame) -> DataFrame:
    """Both strands of each node: (k, kmer, w, coverage) with w = kmer and, unless a palindrome, its reverse complement."""
    rows = nodes.withColumn("rc", S.revcomp("kmer"))
    strands = F.when(F.col("kmer") == F.col("rc"), F.array("kmer")).otherwise(F.array("kmer", "rc"))
    return rows.withColumn("w", F.explode(strands)).drop("rc")


def edge_masks(counts: DataFrame) -> DataFrame:
    """(k, kmer, edges) for each node with an observed extension, from the nodes of k + 1."""
    rows = oriented(counts.where("k > 1").select("k", "kmer")).select((F.col("k") - 1).alias("k"), F.left("w", F.col("k") - 1).alias("p"), F.right("w", F.lit(1)).alias("base")).where("k > 0")
    rows = rows.withColumn("rc", S.revcomp("p"))
    bits = F.when(F.col("p") == F.col("rc"), S.edge_bit(0, "base").bitwiseOR(S.edge_bit(1, "base"))).when(F.col("p") < F.col("rc"), S.edge_bit(0, "base")).otherwise(S.edge_bit(1, "base"))
    return rows.groupBy("k", F.least("p", "rc").alias("kmer")).agg(F.bit_or(bits).alias("edges"))


def build_nodes(reads: DataFrame, min_k: int = 2, max_k: int = 12) -> DataFrame:
    """(k, kmer, coverage, edges, is_palindrome)."""
    counts = count_kmers(reads, min_k, max_k)
    return with_edges(counts)


def with_edges(counts: DataFrame) -> DataFrame:
    """counts(k, kmer, coverage) with edges and is_palindrome.

    Counts and masks are aggregated together on one key, so adding the masks costs one shuffle.
    """
    none = F.lit(0)
    masks = edge_masks(counts).select("k", "kmer", none.cast("long").alias("coverage"), "edges")
    both = counts.select("k", "kmer", "coverage", none.alias("edges")).unionByName(masks)
    merged = both.groupBy("k", "kmer").agg(F.sum("coverage").alias("coverage"), F.bit_or("edges").alias("edges")).where("coverage > 0")
    return merged.withColumn("is_palindrome", S.is_palindrome("kmer"))


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes and the two of k = 1, which are never counted."""
    first = nodes.sparkSession.range(2).select(F.lit(1).cast("long").alias("k"), F.when(F.col("id") == 0, "A").otherwise("C").alias("kmer"), F.lit(0).cast("long").alias("coverage"))
    return first.unionByName(nodes.select("k", "kmer", "coverage"))


def compact(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nodes dealt by (k, kmer) and sorted, ready to be written by k."""
    n = partitions or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "k", "kmer").sortWithinPartitions("k", "kmer")
