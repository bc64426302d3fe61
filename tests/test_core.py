import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import seq as S
from helixframe.operators import cluster, components, kmers, links, maintain, reads, seeds, stats, visits, walks
from helixframe.plans.graph import KmerGraph, Phases, assemble
from helixframe.sources import fastx, graphs
from tests import model

DNA = st.text("ACGT", min_size=1, max_size=30)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def make(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def some_reads(seed=1, n=8, size=40):
    r = random.Random(seed)
    genome = "".join(r.choice("ACGT") for _ in range(120))
    return [genome[i : i + size] for i in (r.randrange(0, 120 - size) for _ in range(n))]


def as_counts(df):
    return {(r.k, r.kmer): r.coverage for r in df.collect()}


def test_golden_graph(spark):
    nodes = kmers.build_nodes(make(spark, ["TCGA", "AGCA", "TGAC"]), 2, 4)
    got = {(r.k, r.kmer): (r.coverage, r.is_palindrome, r.forward, r.reverse) for r in graphs.describe(nodes).join(nodes.select("k", "kmer"), ["k", "kmer"]).collect()}
    assert got[2, "GA"] == (3, False, "C", "AG")
    assert got[2, "GC"] == (1, True, "AT", "AT")
    assert got[2, "CG"] == (1, True, "A", "A")
    assert got[3, "CGA"] == (2, False, "", "A")
    assert got[4, "TCGA"] == (1, True, "", "")
    assert len(got) == 14
    kept = {(r.k, r.kmer) for r in maintain.clean(nodes, 2).collect()}
    assert set(got) - kept == {(4, "AGCA"), (4, "GTCA"), (4, "TCGA")}


@FEW
@given(st.lists(DNA, min_size=1, max_size=5))
def test_counts_match_model_either_way(spark, seqs):
    want = model.count(seqs, 2, 6)
    for pre in (True, False):
        assert as_counts(kmers.count_kmers(make(spark, seqs), 2, 6, pre)) == dict(want)


@FEW
@given(st.lists(DNA, min_size=1, max_size=4), st.data())
def test_strand_does_not_matter(spark, seqs, data):
    flipped = [model.rc(s) if data.draw(st.booleans()) else s for s in seqs]
    assert as_counts(kmers.count_kmers(make(spark, seqs), 2, 5)) == as_counts(kmers.count_kmers(make(spark, flipped), 2, 5))


def test_edges_and_clean_match_model(spark):
    for seed in range(3):
        seqs = some_reads(seed)
        counts = model.count(seqs, 3, 8)
        nodes = kmers.build_nodes(make(spark, seqs), 3, 8).cache()
        ext = model.extensions(counts)
        assert {(r.k, r.kmer): r.edges for r in nodes.collect()} == {n: model.mask(*ext[n]) for n in counts}
        assert all(r.n <= r.u for r in nodes.groupBy("k").agg(F.count("*").alias("n")).select("n", S.universe_size("k").alias("u")).collect())
        kept = maintain.clean(nodes, 4).cache()
        assert {(r.k, r.kmer) for r in kept.collect()} == model.clean(counts, 4)
        assert maintain.clean(kept, 4).count() == kept.count()


def test_subtract_keeps_what_children_need(spark):
    nodes = kmers.build_nodes(make(spark, some_reads(5)), 2, 6).cache()
    top = nodes.where("k = 6").select("k", "kmer", F.lit(1).alias("amount"))
    left = as_counts(maintain.subtract_coverage(nodes, top))
    before = as_counts(nodes)
    assert set(left) == set(before) and all(0 <= left[n] <= before[n] for n in left)
    assert all(left[n] == max(0, before[n] - 1) for n in left if n[0] == 6)
    for k, x in left:
        if k == 6 or x == model.rc(x):
            continue
        for w in (x, model.rc(x)):
            assert left[k, x] >= min(before[k, x], sum(left.get((k + 1, model.canon(w + c)), 0) for c in "ACGT"))


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([*zip(order[:-1], order[1:], strict=True), (1000, 1001), (7000, 7000)], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(order, 0), 1000: 1000, 1001: 1000}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_components_of_small_and_large_graphs_agree(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [(None, "n01"), ("é", "z")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    small, large = (sorted(map(tuple, components.connected_components(edges, small_edges=n).collect())) for n in (10**6, 0))
    assert small == large and ("é", "z") in small


def test_walks_equal_the_model():
    r = random.Random(5)
    for _ in range(300):
        genome = "".join(r.choice("ACGT") for _ in range(r.randrange(15, 50)))
        low = r.randrange(3, 6)
        counts = model.count([genome[i : i + r.randrange(6, 20)] for i in (r.randrange(0, 10) for _ in range(4))], low, low + 3)
        edges = model.extensions(counts)
        nodes = {x: (counts[k, x], model.mask(*edges[k, x])) for k, x in counts if r.random() < 0.9}
        for x in list(nodes)[:5]:
            for w in (x, model.rc(x)):
                n, path = model.walk(w, nodes, low)
                assert walks.walk(w, nodes, low) == (n, path[-1])


def test_choice_callback():
    nodes = {model.canon(x): (1, 255) for x in ("AAC", "AACA", "AACG", "ACGT", "CATT")}
    asked = []
    far = walks.walk("AAC", nodes, 3, choose=lambda options, at: asked.append((options, at)) or options[-1])
    assert asked[0] == (["A", "G"], "AAC") and far != walks.walk("AAC", nodes, 3)


def test_contigs_equal_the_model(spark):
    seqs = some_reads(13, n=7, size=30)
    nodes = maintain.clean(kmers.build_nodes(make(spark, seqs), 6, 8), 6).cache()
    groups = cluster.clusters(nodes, 6).cache()
    info = {r.kmer: (r.coverage, r.edges) for r in nodes.collect()}
    parts = {}
    for r in groups.collect():
        parts.setdefault((r.group_id, r.strength), {})[r.kmer] = info[r.kmer]
    want = []
    for (_, strength), part in parts.items():
        for g, start in model.settled(part, strength, 6):
            if start:
                length, path = model.walk(start, g, 6)
                want.append((min(f"{len(x):03d}:{x}" for x in g), abs(length)))
    got = {(r.group_id, r.length) for r in cluster.contigs(cluster.settled_groups(groups, 6), 6).collect()}
    assert set(want) <= got and len({g for g, _ in got}) == len(got)


def test_extraction_marks_every_node_once(spark):
    seqs = some_reads(15, n=10, size=40)
    rows = seeds.extract_all(kmers.build_nodes(make(spark, seqs), 7, 12), 7).collect()
    counts = model.count(seqs, 7, 12)
    covered = {model.canon(r.seq[i : i + k]) for r in rows for k in range(7, 13) for i in range(len(r.seq) - k + 1)}
    assert {x for _, x in counts} <= covered and len({r.seq for r in rows}) == len(rows)
    alone = "ACGGTCATTGCAAGT"  # one read, no fork: one contig, whatever k is
    assert [r.seq for r in seeds.extract_all(kmers.build_nodes(make(spark, [alone]), 7, 9), 7).collect()] == [model.canon(alone)]


def test_unbroken_windows(spark):
    nodes = spark.createDataFrame([(3, "ACG"), (3, "CCG"), (3, model.canon("GGT")), (4, "ACGG"), (5, model.canon("ACGGT")), (4, model.canon("CGGT"))], "k long, kmer string")
    got = {(r.k, r.pos) for r in visits.unbroken_windows(make(spark, ["ACGGTT"]), [3, 4, 5], nodes).collect()}
    assert got == {(3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (5, 0)}
    assert {r.k for r in visits.unbroken_windows(make(spark, ["ACGGTT"]), [3, 4, 5], nodes.where("kmer != 'CCG'")).collect()} == {3}


def test_links(spark):
    nodes = kmers.build_nodes(make(spark, some_reads(2)), 2, 6).cache()
    counts = as_counts(nodes)
    ups = {(r.k, r.kmer, r.side): r.parent for r in links.parents(nodes).collect()}
    assert ups == {(k, x, s): model.canon(x[1:] if s == 0 else x[:-1]) for k, x in counts if k > 2 for s in (0, 1)}
    found = {r.seq: r.coverage for r in links.find(nodes, spark.createDataFrame([("ACG",), ("A" * 6,)], "seq string")).collect()}
    assert found == {"ACG": counts.get((3, "ACG")), "A" * 6: counts.get((6, "A" * 6))}
    at = spark.createDataFrame([("AAAAA", "C")], "w string, base string")
    best = max((k for k in range(2, 7) if (k, model.canon("AAAAAC"[-k:])) in counts), default=None)
    got = links.advance(nodes, at).collect()
    assert ([r.k for r in got] or [None]) == [best]


def test_read_links_match_reads(spark):
    seqs = some_reads(4)
    nodes = kmers.count_kmers(make(spark, seqs), 3, 6)
    counts = model.count(seqs, 3, 6)
    want = {}
    for s in seqs:
        for k in range(3, 6):
            for i in range(len(s) - k):
                a, b = counts[k, model.canon(s[i : i + k])], counts[k, model.canon(s[i + 1 : i + 1 + k])]
                key = k, 1000 * abs(a - b) // max(a, b)
                want[key] = want.get(key, 0) + 1
    assert {(r.k, r.bin): r.n for r in stats.read_link_histogram(nodes).collect()} == want


def test_trim(spark):
    rows = [(0, "NNACGTN", "!!IIIII"), (1, "ACGT", "II!!"), (2, "NNN", "III"), (3, "ACGT", "I"), (4, "", "")]
    df = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    got = {r.read_id: (r.seq, r.qual) for r in reads.trim(df, quality="#").collect()}
    assert got == {0: ("ACGT", "IIII"), 1: ("AC", "II"), 2: ("", ""), 3: ("ACGT", "I"), 4: ("", "")}
    assert reads.trim(df.drop("qual")).orderBy("read_id").first().seq == "ACGT"


def test_pairs(spark):
    df = spark.createDataFrame([(1, "B", "A"), (0, "A", "B"), (2, "A", "A")], "pair_id long, s1 string, s2 string")
    once = reads.unique_pairs(df)
    assert sorted(map(tuple, once.collect())) == [(0, "A", "B", 2), (2, "A", "A", 1)]
    assert reads.unique_pairs(once.drop("dupecount")).count() == 2
    q = spark.createDataFrame([(0, "AC", "5~"), (1, "AC", "!5")], "read_id long, seq string, qual string")
    assert reads.joined_quality(q).first().qual == "5~"


def test_scalars(spark):
    df = spark.createDataFrame([("ACGT",), ("AACA",), ("A",), ("",)], "s string")
    assert [r[0] for r in df.select(S.self_overlap("s")).collect()] == [0, 1, 0, 0]
    assert [r[0] for r in df.select(S.is_palindrome("s")).collect()] == [True, False, False, True]
    assert spark.range(1).select(S.coverage_quality(F.array(F.lit(0), F.lit(5), F.lit(10)))).first()[0] == "!O~"
    assert spark.range(1).select(S.normalise(F.lit("acgtuNé"))).first()[0] == "ACGTTAA"


def test_fastx_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nAC\n  GT \n\n>two\nA\n1 not sequence\nCCC\n>three\n")
    assert sorted(map(tuple, fastx.read_fastx(spark, str(tmp_path / "a.fa")).collect())) == [("one first", "ACGT", None), ("three", "", None), ("two", "A", None)]
    lines = [f"@r{i}\nACGT\n+\n@II{i % 10}\n" for i in range(500)]
    (tmp_path / "b.fq").write_text("".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.name: r.qual for r in fastx.read_fastx(spark, str(tmp_path / "b.fq")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"r{i}": f"@II{i % 10}" for i in range(500)}
    (tmp_path / "c.txt").write_text("hello")
    with pytest.raises(ValueError, match="neither"):
        fastx.read_fastx(spark, str(tmp_path / "c.txt"))
    (tmp_path / "short.fq").write_text("".join(lines[:3]))
    with pytest.raises(ValueError, match="fewer"):
        fastx.read_pairs(spark, str(tmp_path / "b.fq"), str(tmp_path / "short.fq"))
    assert fastx.read_pairs(spark, str(tmp_path / "short.fq"), str(tmp_path / "b.fq")).count() == 3
    (tmp_path / "d.fa").write_text("".join(f">{i}\nACG\n{'ACGT'[i % 4]}\n" for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        pairs = {x.pair_id: x.s1 for x in fastx.read_pairs(spark, str(tmp_path / "d.fa"), str(tmp_path / "d.fa")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pairs == {i: "ACG" + "ACGT"[i % 4] for i in range(40)}


def test_wrapped(spark):
    got = spark.range(1).select(fastx.wrapped(F.lit("A" * 160)), fastx.wrapped(F.lit("A" * 161))).first()
    assert got[0] == "A" * 80 + "\n" + "A" * 80 and got[1].split("\n")[-1] == "A"


def test_tables_and_sinks(spark, tmp_path):
    nodes = kmers.build_nodes(make(spark, some_reads(6)), 2, 5).cache()
    table = graphs.log_table(stats.log_statistics(nodes))
    assert len(table.columns) == 36 and table.count() == 4
    children = graphs.child_table(stats.child_statistics(nodes), stats.child_summary(nodes))
    graphs.write_table(children, str(tmp_path / "children"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "children")).count() == 4
    assert graphs.link_table(stats.read_link_statistics(nodes), stats.read_link_histogram(nodes)).count() >= 1
    KmerGraph(nodes).save(str(tmp_path / "graph"))
    assert as_counts(KmerGraph.load(spark, str(tmp_path / "graph")).nodes) == as_counts(nodes)
    assert graphs.arcs(nodes).count() == 2 * nodes.where("k > 2").count()


def test_walks_never_revisit_and_contigs_are_in_the_graph(spark):
    seqs = some_reads(7, n=12)
    nodes = maintain.clean(kmers.build_nodes(make(spark, seqs), 6, 9), 6).cache()
    groups = cluster.settled_groups(cluster.clusters(nodes, 6), 6)
    have = {r.kmer for r in kmers.count_kmers(make(spark, seqs), 6, 6).collect()}
    rows = cluster.contigs(cluster.merge_groups(nodes, groups, 6), 6).collect()
    assert rows
    for r in rows:
        assert r.length == len(r.seq) and all(model.canon(r.seq[i : i + 6]) in have for i in range(len(r.seq) - 5))


def test_merging_by_joins_equals_merging_in_tasks(spark):
    nodes = maintain.clean(kmers.build_nodes(make(spark, some_reads(9, n=5, size=25)), 5, 7), 5).cache()
    groups = cluster.settled_groups(cluster.clusters(nodes, 5), 5).cache()
    a, b = (sorted(map(tuple, cluster.contigs(cluster.merge_groups(nodes, groups, 5, max_nodes=n), 5).collect())) for n in (10**6, 0))
    assert a == b


def test_cluster_partition(spark):
    nodes = maintain.clean(kmers.build_nodes(make(spark, some_reads(8)), 6, 8), 6).cache()
    info = {r.kmer: (r.coverage, r.edges) for r in nodes.collect()}
    got = {r.kmer: r.group_id for r in cluster.clusters(nodes, 6).collect()}
    owned = {model.canon(p[i : i + k]) for p in info if p == model.rc(p) for k in range(6, len(p) + 1) for i in range(len(p) - k + 1)}
    free = {x: v for x, v in info.items() if x not in owned}
    want = {x: min(f"{len(y):03d}:{y}" for y in part) for part, _ in walks.parts_within(free, cluster.CUTOFF) for x in part}
    assert {x: g for x, g in got.items() if x in free} == want
    assert cluster.cluster_stats(cluster.clusters(nodes, 6)).agg(F.sum("num_nodes")).first()[0] == len(info)


def test_unitigs_cover_each_node_once(spark):
    seqs = some_reads(10)
    nodes = kmers.build_nodes(make(spark, seqs), 7, 8).cache()
    rows = cluster.unitigs(nodes, 7).collect()
    seen = [model.canon(r.seq[i : i + 7]) for r in rows for i in range(len(r.seq) - 6)]
    assert sorted(seen) == sorted(r.kmer for r in nodes.where("k = 7").collect())


def test_assembly(spark):
    seqs = some_reads(11, n=40, size=50)
    phases = Phases(spark)
    rows = assemble(make(spark, seqs), 11, 15, min_contig=30, phases=phases).collect()
    assert rows and max(r.length for r in rows) > 50 and "merge" in phases.seconds
    text = fastx.contig_text(spark.createDataFrame(rows)).first().value
    assert text.startswith(">CONTIG_") and "average coverage:" in text


def test_repl_like_use(spark):
    g = KmerGraph.from_sequence(spark, "tcga")
    assert g.find("TCGA").first().coverage == 1
    assert g.statistics().first().total == 6
    assert g.extract("TCG", 2).count() == 1
