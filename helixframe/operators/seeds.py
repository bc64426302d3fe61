"""Where to start and simpler ways to extend."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import regions
from .links import coverage_unambiguous, surface
from .maintain import deep_mark
from .stats import log_mass_hook
from .walks import greedy, key, link_strength, rc


def _off_hook(nodes: DataFrame, hooks: DataFrame) -> DataFrame:
    """nodes with off, the distance of the coverage's logarithm to the hook of their k."""
    return nodes.join(hooks, "k").withColumn("off", F.abs(S.log2_floor("coverage") - F.col("hook")).cast("long")).drop("hook")


def surface_seeds(nodes: DataFrame, n: int = 1) -> DataFrame:
    """Nodes without children nearest to the log-mass hook; ties by longer k, then k-mer."""
    return _off_hook(surface(nodes), log_mass_hook(nodes)).orderBy("off", F.desc("k"), "kmer").limit(n)


def unambiguous_seeds(nodes: DataFrame, threshold: float, n: int = 1) -> DataFrame:
    """Nodes in the hook's bin with at most one close child on a side, longest first."""
    return _off_hook(coverage_unambiguous(nodes, threshold), log_mass_hook(nodes)).where("off = 0").orderBy(F.desc("k"), "kmer").limit(n)


def next_seeds(nodes: DataFrame, extracted: DataFrame, n: int = 1) -> DataFrame:
    """The longest nodes that no extracted k-mer contains."""
    done = deep_mark(nodes, extracted, 1).select("k", "kmer")
    return nodes.join(done, ["k", "kmer"], "left_anti").orderBy(F.desc("k"), "kmer").limit(n)


def steady(seed: str, coverage: dict[str, int], threshold: float) -> tuple[str, list[int]]:
    """Extend to both sides while exactly one next k-mer is close in coverage and none is met twice."""
    used = {key(seed)}

    def ahead(w: str) -> tuple[str, list[int]]:
        out, covs = [], []
        while True:
            here = coverage.get(key(w), 0)
            close = [c for c in "ACGT" if key(w[1:] + c) in coverage and link_strength(here, coverage[key(w[1:] + c)]) ** 2 < threshold]
            if len(close) != 1 or key(w[1:] + close[0]) in used:
                return "".join(out), covs
            w = w[1:] + close[0]
            used.add(key(w))
            out.append(close[0])
            covs.append(coverage[key(w)])

    forward, after = ahead(seed)
    backward, before = ahead(rc(seed))
    return rc(backward) + seed + forward, before[::-1] + [coverage.get(key(seed), 0)] * len(seed) + after


def steady_contigs(nodes: DataFrame, seeds: DataFrame, threshold: float = 0.0025, max_nodes: int = regions.MAX_NODES, drop_up_to: int = 150, long_from: int = 500) -> DataFrame:
    """seeds(seq) -> (seed, seq, length, average, deviation, is_long); contigs of up to drop_up_to bases are dropped.

    Every task gets a graph of up to max_nodes, which is checked; a larger one is dealt out by regions of
    close pairs, which steps never leave.
    """
    schema = "seed string, seq string, length long, average double, deviation double"

    def walk_all(graph: dict[str, int], starts: list[str]):
        for s in starts:
            seq, cov = steady(s, graph, threshold)
            yield s, seq, len(seq), float(pd.Series(cov).mean()), float(pd.Series(cov).std(ddof=0))

    graph = regions.held(nodes, "coverage", max_nodes)
    if graph is None:
        out = regions.walk_regions(nodes, seeds, regions.by_close_pairs(nodes, seeds, threshold), max_nodes, walk_all, schema)
    else:
        shared = nodes.sparkSession.sparkContext.broadcast(graph)

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame(walk_all(shared.value, pdf.seq), columns=["seed", "seq", "length", "average", "deviation"])

        out = seeds.select("seq").repartition(nodes.sparkSession.sparkContext.defaultParallelism, "seq").mapInPandas(run, schema)
    return out.where(F.col("length") > drop_up_to).withColumn("is_long", F.col("length") >= long_from)


def assemble_all(nodes: DataFrame, min_k: int, max_nodes: int = regions.MAX_NODES) -> DataFrame:
    """Greedy contigs from every node not yet used with at least average coverage, longest k-mers first.

    Each contig takes its nodes away from the next ones, so this is one sequence of steps: on the driver
    for a graph of up to max_nodes, which is checked, otherwise one for each region over contexts of min_k
    bases, since contigs take nodes of their own region only.
    """
    schema = "seq string, length long, average double"
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("sum")).first()
    average = (size["sum"] or 0) / max(1, size["n"])

    def take(graph: dict[str, int], starts: list[str]):
        left = dict(graph)
        for kmer in sorted(starts, key=lambda x: (-len(x), x)):
            if kmer not in left or graph[kmer] < average or len(kmer) < min_k:
                continue
            seq, cov = greedy(kmer, left, min_k)
            for k in range(min_k, len(kmer) + 1):
                for i in range(len(seq) - k + 1):
                    left.pop(key(seq[i : i + k]), None)
            yield key(seq), len(seq), sum(cov) / len(cov)

    graph = regions.held(nodes, "coverage", max_nodes)
    if graph is not None:
        return nodes.sparkSession.createDataFrame(list(take(graph, list(graph))), schema)
    starts = nodes.select(F.col("kmer").alias("seq"))
    return regions.walk_regions(nodes, starts, regions.by_context(nodes, starts, min_k), max_nodes, take, schema)


def extract_all(nodes: DataFrame, min_overlap: int = 7, max_nodes: int = regions.MAX_NODES) -> DataFrame:
    """(seq, length) of unambiguous extensions of every node not yet marked, the longest k-mers first.

    A walk follows the only base seen behind its context; where none was seen it falls back to shorter
    contexts of min_overlap - 1 bases at least.  It ends at a fork, at a palindrome it falls back to, and
    behind the base that leads to a marked node.  Nodes on the way are marked with all that they contain,
    for later walks too, and such short contexts connect all, so this is one sequence of steps over a graph of
    checked size.
    """
    masks = regions.held(nodes, "edges", max_nodes)
    if masks is None:
        raise ValueError(f"over {max_nodes} nodes or {regions.MAX_BYTES} bytes of k-mers; prune the graph or raise max_nodes")
    marked: set[str] = set()

    def mark(w: str) -> None:
        todo = [w]
        while todo:
            x = todo.pop()
            if (name := key(x)) not in marked:
                marked.add(name)
                if len(x) > 2:
                    todo += [x[1:], x[:-1]]

    def bases(w: str) -> list[str]:
        bits = masks.get(key(w), 0)
        bits = bits >> 4 if w == key(w) else bits
        return [c for i, c in enumerate("ACGT") if bits & (8 >> i)]

    def ahead(w: str) -> str:
        grown = []
        while True:
            mark(w)
            seen = bases(w)
            while not seen and len(w) >= min_overlap:
                w = w[1:]
                if w == rc(w):
                    break
                seen = bases(w)
            if len(seen) != 1:
                return "".join(grown)
            while len(w) > 1 and key(w + seen[0]) not in masks:
                w = w[1:]
            w += seen[0]
            grown.append(seen[0])
            if key(w) in marked or key(w) not in masks:
                return "".join(grown)

    out = []
    for kmer in sorted(masks, key=lambda x: (-len(x), x)):
        if kmer not in marked:
            grown = ahead(kmer)
            seq = rc(kmer + grown) + ahead(rc(kmer))
            out.append((key(seq), len(seq)))
    return nodes.sparkSession.createDataFrame(out, "seq string, length long")
