import random

import pytest
from pyspark.sql import functions as F

from helixframe import fixtures as X
from helixframe import queries
from helixframe.operators import cluster, compaction, walks
from tests import model, parity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    parity.same(df.collect(), df.columns, con.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["k", "kmer", "coverage"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def letters(spark):
    return [r.seq for r in X.reference_reads(spark, DATA).collect()]


def test_steady_contigs_start_from_all_nodes(spark):
    counts = {x: n for (_, x), n in model.count(letters(spark), 16, 16).items()}
    close = lambda a, b: ((counts[a] - counts[b]) / max(counts[a], counts[b])) ** 2 < 0.3
    want = {}
    for seed in counts:
        used, grown = {seed}, {}
        for start in (seed, model.rc(seed)):
            grown[start], at = "", start
            while True:
                ways = [at[1:] + c for c in "ACGT" if model.canon(at[1:] + c) in counts and close(model.canon(at), model.canon(at[1:] + c))]
                if len(ways) != 1 or model.canon(ways[0]) in used:
                    break
                at = ways[0]
                used.add(model.canon(at))
                grown[start] += at[-1]
        seq = model.rc(grown[model.rc(seed)]) + seed + grown[seed]
        if len(seq) > 150:
            want[seed] = seq
    assert {r.seed: r.seq for r in queries.steady_contigs(spark, DATA).collect()} == want


def test_merged_contigs_merge_until_nothing_merges(spark, monkeypatch):
    r = random.Random(20)
    whole = "".join(r.choice("ACGT") for _ in range(60))
    counts = model.count([whole[i : i + r.randrange(14, 30)] for i in (r.randrange(0, 46) for _ in range(12))], 9, 11)
    edges = model.extensions(counts)
    info = {x: (counts[k, x], model.mask(*edges[k, x])) for k, x in model.clean(counts, 9) if x != model.rc(x)}
    parts = [g for part, strength in walks.parts_within(info, cluster.CUTOFF) for g in walks.settle(part, strength, 9)]
    rows = [(min(f"{len(y):03d}:{y}" for y in g["nodes"]), len(x), x, *v, *g["ends"], g["length"], g["strength"], g["cyclic"], False) for g in parts for x, v in g["nodes"].items()]
    nodes = spark.createDataFrame([(len(x), x, *v, False) for x, v in info.items()], "k long, kmer string, coverage long, edges int, is_palindrome boolean")
    monkeypatch.setattr(queries, "_groups", lambda *_: (nodes, spark.createDataFrame(rows, cluster.GROUP_SCHEMA)))
    named = lambda: {min(f"{len(y):03d}:{y}" for y in g["nodes"]): g | {"has_palindrome": False} for g in parts}
    once, full = (set(walks.merge_all(named(), 9, n)) for n in (1, 1000))
    assert len(once) == 2 and len(full) == 1
    assert {x.group_id for x in queries.merged_contigs(spark, DATA).collect()} == full


def test_maxcov_starts_from_all_nodes_of_the_level(spark):
    seeds = {x for _, x in model.count(letters(spark), 12, 12)}
    assert {r.seed for r in queries.maxcov_contig(spark, DATA).select("seed").collect()} == seeds


def test_maxcov_walks_to_the_end(spark):
    r = random.Random(14)
    seq = "".join(r.choice("ACGT") for _ in range(12_000))
    counts = model.count([seq], 20, 20)
    assert len(counts) == len(seq) - 19
    nodes = spark.createDataFrame([(x, n) for (_, x), n in counts.items()], "kmer string, coverage long")
    rows = cluster.max_coverage_contigs(nodes, spark.createDataFrame([(seq[:20],)], "seq string"), 19).collect()
    assert [r.seq for r in rows] == [seq]


def test_maxcov_coverage_is_the_highest_within_k():
    seq, cov = "AACCAGTCTTGCA", [1, 1, 7, 2, 3, 1, 5, 1, 1]  # of its 5-mers
    nodes = {model.canon(seq[i : i + 5]): c for i, c in enumerate(cov)}
    assert len(nodes) == len(cov)
    got = walks.greedy(seq[:5], nodes, 4)
    assert got == (seq, [1] * 5 + [max(cov[i : i + 6]) for i in range(1, len(cov))])


def test_reach_has_no_bound_of_steps(spark):
    edges = spark.range(1500).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", F.col("id") + 1).alias("dst"))
    edges = edges.union(spark.createDataFrame([("x", "y")], "src string, dst string"))
    got = [r.node for r in cluster.reach(edges, spark.createDataFrame([("00000",), ("alone",)], "node string")).collect()]
    assert sorted(got) == [*(f"{i:05d}" for i in range(1501)), "alone"]


def brute_unitigs(seqs, k):
    found = {x for _, x in model.count(seqs, k, k + 1)}
    ahead = lambda w: [w[1:] + c for c in "ACGT" if model.canon(w + c) in found]

    def step(w):
        ways = ahead(w)
        if len(ways) == 1 and len(ahead(model.rc(ways[0]))) == 1 and model.canon(ways[0]) != model.canon(w):
            return ways[0]

    seen, out = set(), []
    for x in sorted(x for x in found if len(x) == k):
        if x in seen:
            continue
        back = [x]
        while (w := step(model.rc(back[-1]))) and model.rc(w) != x:
            back.append(model.rc(w))
        line = [x if w else back[-1]]  # a ring starts at its smallest k-mer
        while (w := step(line[-1])) and w != line[0]:
            line.append(w)
        seen.update(map(model.canon, line))
        out.append((model.canon(line[0] + "".join(w[-1] for w in line[1:])), len(line)))
    return sorted(out)


def test_document_unitigs_equal_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnop ") for _ in range(n)) for n in (0, 3, 15, 16, 40, 200, 700)]
    ring = "".join(r.choice("abcd") for _ in range(41))
    texts += [texts[-1][100:400] + texts[-2], texts[-1][250:300] * 2, texts[-1][500:560] + texts[-1][90:150], ring * 3, None, texts[-1]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = [x.seq for x in X.reads(spark, str(tmp_path)).collect() if x.seq]
    rows = queries.document_unitigs(spark, str(tmp_path)).collect()
    want = brute_unitigs(seqs, 15)
    assert sorted((x.seq, x.n_nodes) for x in rows) == want
    assert sum(x.coverage for x in rows) == sum(max(0, len(s) - 14) for s in seqs)
    assert len(want) > 6 and 41 in {n for _, n in want}


def test_document_unitigs_of_many_groups_and_rounds(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    line = "".join(r.choice("ACGT") for _ in range(900))
    rings = ["".join(r.choice("ACGT") for _ in range(n)) for n in (9, 150)]
    seqs = [line, line[200:260] + "A" * 40 + line[400:500], model.rc(line[300:600]), line[:300] + line[500:520], "ACACACACACACACACACACAC", *(x * (2 + 30 // len(x)) for x in rings), "ACG", "", line]
    reads = spark.createDataFrame([(x,) for x in [*seqs, None]], "seq string").repartition(3)
    for k in (5, 9, 15):
        rows = compaction.unitigs(reads, k, small=0, group=1).collect()
        assert sorted((x.seq, x.n_nodes) for x in rows) == brute_unitigs(seqs, k)
        assert sum(x.coverage for x in rows) == sum(max(0, len(s) - k + 1) for s in seqs)
        assert sorted(rows) == sorted(compaction.unitigs(reads, k).collect())
    assert compaction.unitigs(reads.where("seq = ''"), 15).collect() == []

    def refuse(*_, **__):
        raise AssertionError("components of single k-mers take rounds over the whole graph")

    monkeypatch.setattr(cluster, "connected_components", refuse)
    spark.createDataFrame([(1, "some text of the documents")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [x.length for x in queries.document_unitigs(spark, str(tmp_path)).collect()] == [22]
