"""Clusters of nodes, their neighbourhood, contigs and merging.

A node's id is its k, three digits, a colon and its k-mer: ids order by (k, k-mer), and a group is named
after the smallest of its nodes, so names don't depend on scheduling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.staging import stage
from . import regions, walks
from .components import connected_components
from .grouped import by_group
from .kmers import oriented
from .links import neighbours, parents
from .maintain import substrings

CUTOFF = 0.05
#: What one task may label alone of a k-mer graph, as connected_components takes it: edges, and bytes of ids.
HELD = {"small_edges": 2_000_000, "small_bytes": 128 << 20}


def node_id(k: Column | str = "k", kmer: Column | str = "kmer") -> Column:
    return F.concat(F.lpad(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), 3, "0"), F.lit(":"), kmer if isinstance(kmer, Column) else F.col(kmer))


def adjacency(nodes: DataFrame, min_k: int) -> DataFrame:
    """H1: (src, dst, strength) between parents and children and between siblings, both of min_k at least, each pair once."""
    few = nodes.where(F.col("k") >= min_k)
    up = parents(few).select(node_id().alias("src"), node_id(F.col("k") - 1, F.col("parent")).alias("dst"), "coverage", F.col("parent_coverage").alias("other"))
    side = neighbours(few).join(few.select("k", "kmer", "coverage"), ["k", "kmer"]).select(node_id().alias("src"), node_id(F.col("k"), F.col("neighbour")).alias("dst"), "coverage", F.col("neighbour_coverage").alias("other"))
    both = up.unionByName(side).where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.abs(S.link_strength("coverage", "other")).alias("strength"))
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("strength").alias("strength"))


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """H1: nodes of start(node) and all that edges(src, dst) lead to in either direction: the components of start's nodes."""
    first = stage(start.select("node").distinct(), "reach-start")
    groups = stage(connected_components(edges, **HELD), "reach-components")
    met = groups.join(first, "node", "left_semi").select("component").distinct()
    return groups.join(met, "component", "left_semi").select("node").union(first).distinct()


def clusters(nodes: DataFrame, min_k: int, cutoff: float = CUTOFF) -> DataFrame:
    """H2: (k, kmer, coverage, edges, group_id, strength, has_palindrome) for nodes of min_k at least.

    Palindromes take what they contain, the longest first (of equal ones the smallest k-mer); the other
    nodes group over links of strength up to cutoff.  strength is the strongest such link in the group.
    """
    few = nodes.where(F.col("k") >= min_k)
    heads = few.where("is_palindrome").select(F.col("k").alias("top"), F.col("kmer").alias("head"))
    inside = substrings_of_heads(heads, min_k)
    owned = inside.groupBy("k", "kmer").agg(F.min(F.struct((-F.col("top")).alias("t"), "head")).alias("m")).select("k", "kmer", node_id(-F.col("m.t"), F.col("m.head")).alias("palindrome"))
    marked = stage(few.join(owned, ["k", "kmer"], "left").withColumn("id", node_id()), "cluster-nodes")
    free = marked.where("palindrome IS NULL").select("id")
    links = adjacency(nodes, min_k).where(F.col("strength") <= cutoff)
    links = stage(links.join(free.withColumnRenamed("id", "src"), "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left_semi"), "cluster-links")
    groups = connected_components(links, **HELD).withColumnRenamed("node", "id")
    strongest = links.join(groups.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.max("strength").alias("strength"))
    named = marked.join(groups, "id", "left").withColumn("group_id", F.coalesce("palindrome", "component", "id"))
    return named.join(strongest.withColumnRenamed("component", "group_id"), "group_id", "left").select("k", "kmer", "coverage", "edges", "group_id", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.col("palindrome").isNotNull().alias("has_palindrome"))


def substrings_of_heads(heads: DataFrame, min_k: int) -> DataFrame:
    """(k, kmer, top, head): canonical substrings of each head of min_k bases at least."""
    parts = substrings(heads.select(F.col("head").alias("kmer")), min_k)  # distinct over all heads
    pairs = heads.withColumn("k", F.explode(F.sequence(F.lit(min_k), F.col("top").cast("int")))).withColumn("p", F.explode(F.sequence(F.lit(1), F.col("top").cast("int") - F.col("k") + 1)))
    return pairs.select(F.col("k").cast("long").alias("k"), S.canonical(F.substring(F.col("head"), F.col("p"), F.col("k"))).alias("kmer"), "top", "head").join(parts, ["k", "kmer"], "left_semi").distinct()


def cluster_stats(groups: DataFrame) -> DataFrame:
    """(group_id, num_nodes, mass, strength, endpoint) of clusters; endpoint is the longest node, of equal ones the smallest."""
    deepest = F.min(F.struct((-F.col("k")).alias("d"), "kmer"))
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("num_nodes"), F.sum("coverage").alias("mass"), F.max("strength").alias("strength"), deepest.alias("m")).select("group_id", "num_nodes", "mass", "strength", F.col("m.kmer").alias("endpoint"))


def cluster_adjacency(nodes: DataFrame, groups: DataFrame, min_k: int) -> DataFrame:
    """(g1, g2, link_strength): the weakest difference between two groups, g1 < g2."""
    own = groups.select(node_id().alias("id"), "group_id")
    met = adjacency(nodes, min_k).join(own.select(F.col("id").alias("src"), F.col("group_id").alias("x")), "src").join(own.select(F.col("id").alias("dst"), F.col("group_id").alias("y")), "dst").where("x != y")
    return met.groupBy(F.least("x", "y").alias("g1"), F.greatest("x", "y").alias("g2")).agg(F.min("strength").alias("link_strength"))


GROUP_SCHEMA = "group_id string, k long, kmer string, coverage long, edges int, end0 string, end1 string, length long, strength double, cyclic boolean, has_palindrome boolean"


def settled_groups(groups: DataFrame, min_k: int) -> DataFrame:
    """H3: clusters whose two walks disagree or loop are split; one row for each node, with its group's ends."""

    def run(rows: list):
        for g in walks.settle(_members(rows), float(rows[0].strength), min_k):
            name = min(f"{len(x):03d}:{x}" for x in g["nodes"])
            yield from ((name, len(x), x, c, e, *g["ends"], g["length"], g["strength"], g["cyclic"], rows[0].has_palindrome) for x, (c, e) in g["nodes"].items())

    return by_group(groups, "group_id", run, GROUP_SCHEMA)


def _members(rows: list) -> dict[str, tuple[int, int]]:
    return {r.kmer: (r.coverage, r.edges) for r in rows}


def contigs(groups: DataFrame, min_k: int, min_length: int = 0, max_length: int | None = None) -> DataFrame:
    """(group_id, seq, length, average_coverage, cyclic, has_palindrome) of settled groups, min_length < length <= max_length."""

    def run(rows: list):
        first = rows[0]
        seq, cov = walks.contig(first.end0, _members(rows), min_k)
        yield first.group_id, walks.key(seq), len(seq), cov, first.cyclic, first.has_palindrome

    out = by_group(groups, "group_id", run, "group_id string, seq string, length long, average_coverage double, cyclic boolean, has_palindrome boolean").where(F.col("length") > min_length)
    return out if max_length is None else out.where(F.col("length") <= max_length)


def merge_round(nodes: DataFrame, groups: DataFrame, min_k: int) -> tuple[DataFrame, int]:
    """One pass over all pairings, ascending by (link_strength, g1, g2); (groups, number of merges).

    A pairing is due once it comes first among those left that touch either of its groups.  All that are
    due touch different groups and are tested together; that gives what testing one by one gives.
    """
    todo = stage(cluster_adjacency(nodes, groups, min_k), "pairings")
    merges = 0
    while not todo.isEmpty():
        rank = F.struct("link_strength", "g1", "g2")
        ends = todo.select(F.explode(F.array("g1", "g2")).alias("g"), rank.alias("r")).groupBy("g").agg(F.min("r").alias("r"))
        due = todo.withColumn("r", rank).join(ends.select(F.col("g").alias("g1"), F.col("r").alias("r1")), "g1").join(ends.select(F.col("g").alias("g2"), F.col("r").alias("r2")), "g2").where("r = r1 AND r = r2").select("g1", "g2", "link_strength")
        due = stage(due, "pairings-due")
        member = due.select(F.col("g1").alias("pair"), "link_strength", F.explode(F.array("g1", "g2")).alias("group_id"))

        def test(rows: list):
            halves = [[r for r in rows if r.group_id == g] for g in sorted({r.group_id for r in rows})]
            if len(halves) != 2:
                return
            info = [{"ends": (h[0].end0, h[0].end1), "length": h[0].length} for h in halves]
            best = walks.joined(*info, _members(rows), min_k)
            if best is not None:
                strength = max(*(r.strength for r in rows), rows[0].link_strength)
                for h in halves:
                    yield h[0].group_id, halves[0][0].group_id, *best[1], best[0], strength, any(r.cyclic for r in rows), any(r.has_palindrome for r in rows)

        merged = by_group(groups.join(member, "group_id"), "pair", test, "old string, new string, end0 string, end1 string, length long, strength double, cyclic boolean, has_palindrome boolean")
        merged = stage(merged, "merged")
        todo = todo.join(due.select("g1", "g2"), ["g1", "g2"], "left_anti")
        if not merged.isEmpty():
            merges += merged.count() // 2
            new = merged.select(F.col("old").alias("group_id"), "new", *(F.col(x).alias(f"n_{x}") for x in ("end0", "end1", "length", "strength", "cyclic", "has_palindrome")))
            groups = stage(groups.join(new, "group_id", "left").select(F.coalesce("new", "group_id").alias("group_id"), "k", "kmer", "coverage", "edges", *(F.coalesce(f"n_{x}", x).alias(x) for x in ("end0", "end1", "length", "strength", "cyclic", "has_palindrome"))), "groups")
            moved = merged.select("old", "new")
            for g in ("g1", "g2"):
                todo = todo.join(moved.select(F.col("old").alias(g), F.col("new").alias("to")), g, "left").withColumn(g, F.coalesce("to", g)).drop("to")
            todo = todo.where("g1 != g2").groupBy(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).agg(F.min("link_strength").alias("link_strength"))
        todo = stage(todo, "pairings")
    return groups, merges


def merge_groups(nodes: DataFrame, groups: DataFrame, min_k: int, max_rounds: int = 0x10000000, max_nodes: int = 500_000) -> DataFrame:
    """H9: rounds until none merges.

    Groups that no chain of pairings connects never meet, so each component of the pairings is merged in
    a task of its own while it has at most max_nodes nodes; larger ones are merged by joins, round by round.
    """
    pairs = cluster_adjacency(nodes, groups, min_k).select(F.col("g1").alias("src"), F.col("g2").alias("dst"))
    comps = connected_components(pairs).withColumnRenamed("node", "group_id")
    named = groups.join(comps, "group_id", "left").withColumn("component", F.coalesce("component", "group_id"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = stage(named.join(sizes, "component"), "merge-input")
    columns = [f.split()[0] for f in GROUP_SCHEMA.split(", ")]

    def run(rows: list):
        parts: dict[str, dict] = {}
        for r in rows:
            own = parts.setdefault(r.group_id, {"nodes": {}, "ends": (r.end0, r.end1), "length": r.length, "strength": r.strength, "cyclic": r.cyclic, "has_palindrome": r.has_palindrome})
            own["nodes"][r.kmer] = r.coverage, r.edges
        for name, g in walks.merge_all(parts, min_k, max_rounds).items():
            yield from ((name, len(x), x, c, e, *g["ends"], g["length"], g["strength"], g["cyclic"], g["has_palindrome"]) for x, (c, e) in g["nodes"].items())

    out = by_group(named.where(F.col("size") <= max_nodes).select("component", *columns), "component", run, GROUP_SCHEMA)
    large = named.where(F.col("size") > max_nodes).select(*columns)
    if large.isEmpty():
        return out
    for _ in range(max_rounds):
        large, merges = merge_round(nodes, large, min_k)
        if not merges:
            break
    return out.unionByName(large.select(*columns))


def unitigs(nodes: DataFrame, k: int) -> DataFrame:
    """(seq, length, n_nodes, coverage) of maximal chains of k-mers with one way on and one way back.

    Chains are the components over unique-successor links; a chain's nodes meet in one task to be put in
    order.  A ring is cut before its smallest k-mer.  seq is canonical.
    """
    level = nodes.where(F.col("k") == k)
    strand = oriented(level.select("k", "kmer", "coverage", "edges", "is_palindrome")).withColumn("on", F.when(F.col("w") == F.col("kmer"), F.expr("edges div 16").cast("int")).otherwise(F.col("edges").bitwiseAND(F.lit(15))))
    strand = strand.withColumn("back", F.when(F.col("w") == F.col("kmer"), F.col("edges").bitwiseAND(F.lit(15))).otherwise(F.expr("edges div 16").cast("int")))
    a = strand.where((F.bit_count("on") == 1) & ~F.col("is_palindrome")).select(F.col("w").alias("wa"), F.col("kmer").alias("src"), F.right("w", F.lit(k - 1)).alias("core"), "on")
    b = strand.where((F.bit_count("back") == 1) & ~F.col("is_palindrome")).select(F.col("w").alias("wb"), F.col("kmer").alias("dst"), F.left("w", F.lit(k - 1)).alias("core"), F.right("w", F.lit(1)).alias("base"))
    links = a.join(b, "core").where(F.call_function("shiftright", F.lit(8), F.instr(F.lit(S.BASES), F.col("base")) - 1) == F.col("on")).where("src != dst")
    links = stage(links.select("wa", "wb", "src", "dst"), "unitig-links")
    once = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))  # both strands have each link
    comp = connected_components(once, **HELD).withColumnRenamed("node", "kmer")
    rows = level.select("kmer", "coverage").join(comp, "kmer", "left").select("kmer", "coverage", F.coalesce("component", "kmer").alias("chain"))
    nexts = links.groupBy(F.col("src").alias("kmer")).agg(F.collect_list(F.struct("wa", "wb")).alias("nexts"))
    rows = rows.join(nexts, "kmer", "left")

    def run(rows: list):
        on = {x["wa"]: x["wb"] for r in rows for x in r.nexts or ()}
        reached = set(on.values())
        starts = sorted(w for w in on if w not in reached)
        w = starts[0] if starts else min(r.kmer for r in rows)
        seq, seen = [w], {walks.key(w)}
        while (w := on.get(w)) is not None and walks.key(w) not in seen:
            seen.add(walks.key(w))
            seq.append(w[-1])
        yield walks.key("".join(seq)), sum(map(len, seq)), len(rows), sum(r.coverage for r in rows)

    return by_group(rows, "chain", run, "seq string, length long, n_nodes long, coverage long")


def max_coverage_contigs(nodes: DataFrame, seeds: DataFrame, min_k: int, max_nodes: int = regions.MAX_NODES) -> DataFrame:
    """seeds(seq) -> (seed, seq, length, quality): greedy extension to both sides by the best covered base.

    Every task gets a graph of up to max_nodes, which is checked.  A larger one is dealt out by regions
    over shared contexts of min_k bases, since each step keeps that many; only a region may not be larger.
    """
    schema = "seed string, seq string, length long, cov array<long>"

    def walk_all(graph: dict[str, int], starts: list[str]):
        for s in starts:
            seq, cov = walks.greedy(s, graph, min_k)
            yield s, seq, len(seq), cov

    graph = regions.held(nodes, "coverage", max_nodes)
    if graph is None:
        out = regions.walk_regions(nodes, seeds, regions.by_context(nodes, seeds, min_k), max_nodes, walk_all, schema)
    else:
        coverage = nodes.sparkSession.sparkContext.broadcast(graph)

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame(walk_all(coverage.value, pdf.seq), columns=["seed", "seq", "length", "cov"])

        out = seeds.select("seq").repartition(nodes.sparkSession.sparkContext.defaultParallelism, "seq").mapInPandas(run, schema)
    return out.select("seed", "seq", "length", S.coverage_quality("cov").alias("quality"))
