import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe import __main__ as cli
from helixframe.functions import seq as S
from helixframe.operators import cluster, kmers, seeds, stats, visits
from helixframe.sources import plots
from tests import model
from tests.test_core import as_counts, make, some_reads


def test_assemble_compare_and_rmdup(spark, tmp_path):
    r = random.Random(1)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    cuts = [r.randrange(0, 240) for _ in range(60)]
    for name in ("one", "two"):
        (tmp_path / f"{name}.fq").write_text("".join(f"@r{i}\n{genome[c : c + 60]}\n+\n{'I' * 60}\n" for i, c in enumerate([*cuts, *cuts])))
    (tmp_path / "ref.fa").write_text(f">g\n{genome}\n")
    one, two = str(tmp_path / "one.fq"), str(tmp_path / "two.fq")
    cli.main(["assemble", one, "-k", "13", "-m", "16", "-T", "#", "-l", "60", "-o", str(tmp_path / "contigs"), "-s", str(tmp_path / "tables"), "-d", str(tmp_path / "graph")])
    contigs = [x.value for x in spark.read.text(str(tmp_path / "contigs")).collect()]
    assert any(x.startswith(">CONTIG_") for x in contigs) and max(int(x.split("length:")[1].split()[0]) for x in contigs if x.startswith(">")) > 200
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tables" / "log_statistics")).count() >= 1
    cli.main(["refcompare", "-L", str(tmp_path / "graph"), "-r", str(tmp_path / "ref.fa"), "-o", str(tmp_path / "cmp")])
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "cmp")).collect()
    assert rows and all(float(x.nodes_percent) == 100 for x in rows)
    cli.main(["rmdup", "-i", one, two, "-o", str(tmp_path / "a"), str(tmp_path / "b")])
    assert spark.read.text(str(tmp_path / "a")).where("value LIKE '>%'").count() == len(set(cuts))
    cli.main(["rmdup", "-i", one, two, "-o", str(tmp_path / "c"), str(tmp_path / "d"), "-Q", "33"])
    joined = [x.value for x in spark.read.option("lineSep", "\n@").text(str(tmp_path / "c")).collect()]
    assert len(joined) == len(set(cuts)) and all(set(x.strip().split("\n")[3]) <= {"q", "~"} for x in joined)
    assert cli.cutoff("5") == 5 and cli.cutoff("#") == "#" and cli.cutoff("20") == 20


def test_standard_input_scripts_and_status(spark, tmp_path, monkeypatch, capsys):
    r = random.Random(5)
    genome = "".join(r.choice("ACGT") for _ in range(120))
    text = "".join(f"@r{i}\n{genome[i : i + 40]}\n+\n{'I' * 40}\n" for i in range(0, 81, 2))
    (tmp_path / "a b.fq").write_text(text)
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
    cli.main(["assemble", "-", "-k", "9", "-m", "11", "-l", "20", "-o", str(tmp_path / "c"), "-d", str(tmp_path / "g"), "--status", str(tmp_path / "status.json")])
    status = json.loads((tmp_path / "status.json").read_text())
    assert status["phase"] is None and set(status["seconds"]) == {"build and prune", "assemble"} and status["executors"]
    (tmp_path / "s").write_text(f"# whole graph\n\nstatistics '{tmp_path}/a b.fq' -k 9 -m 11\nfind -L {tmp_path}/g -S {genome[5:15]}\nshow -L {tmp_path}/g -n 3\npicture -L {tmp_path}/g -o {tmp_path}/p\nquit\nno such command\n")
    cli.main(["script", str(tmp_path / "s")])
    out = capsys.readouterr().out
    assert model.canon(genome[5:15]) in out and "reverse_complement" in out
    whole = spark.read.parquet(str(tmp_path / "p" / "vertices"))
    assert whole.count() == spark.read.parquet(str(tmp_path / "g")).count()
    assert whole.agg(F.max("share")).first()[0] == 1.0 and {x.shape for x in whole.select("shape").distinct().collect()} <= {"cube", "sphere"}
    built = cli.load_reads(spark, [str(tmp_path / "a b.fq")], True, None, 9).count()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
    assert built == cli.load_reads(spark, ["-"], True, None, 9).count() == 41


def test_hooks(spark):
    seqs = some_reads(3)
    nodes = kmers.build_nodes(make(spark, seqs), 3, 6).cache()

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in b.column("kmer").to_pylist()], pa.int64())], ["n"])

    assert visits.visit_kmers(make(spark, seqs), [3, 5], lengths, "n long").agg(F.sum("n")).first()[0] == sum(k * (len(s) - k + 1) for s in seqs for k in (3, 5))
    assert visits.visit_kmers(make(spark, ["A" * 9]), [3], lengths, "n long", nodes.where("kmer = 'x'")).count() == 0
    assert {r.k: r.n for r in visits.fold_nodes(nodes, F.count("*").alias("n")).collect()} == {r.k: r.n for r in nodes.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert visits.group_by_links(nodes, 3, F.col("strength") <= 2).select("component").distinct().count() == 1


def test_windows_of_long_reads(spark):
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (1, 63, 64, 65, 127, 128, 129, 400)]
    got = sorted((x.read_id, x.k, x.pos, x.kmer) for x in kmers.windows(make(spark, seqs), [2, 40, 70]).collect())
    assert got == sorted((i, k, p, model.canon(s[p : p + k])) for i, s in enumerate(seqs) for k in (2, 40, 70) for p in range(len(s) - k + 1))
    assert as_counts(kmers.count_kmers(make(spark, seqs), 60, 70)) == dict(model.count(seqs, 60, 70))


def test_seeds_and_simple_contigs(spark):
    seqs = some_reads(12, n=30, size=60)
    nodes = kmers.build_nodes(make(spark, seqs), 12, 14).cache()
    counts = as_counts(nodes)
    assert seeds.surface_seeds(nodes, 3).count() == 3 and seeds.unambiguous_seeds(nodes, 0.5, 3).count() <= 3
    deepest = seeds.next_seeds(nodes, nodes.where("k = 14"), 3).collect()
    assert all(x.k < 14 for x in deepest)
    one = nodes.where("k = 12")
    rows = seeds.steady_contigs(one, one.limit(5).select(F.col("kmer").alias("seq")), 2.0, drop_up_to=0).collect()
    assert all((12, model.canon(x.seq[i : i + 12])) in counts for x in rows for i in range(len(x.seq) - 11))
    rows = seeds.assemble_all(nodes, 12).collect()
    assert rows and all((12, model.canon(x.seq[i : i + 12])) in counts for x in rows for i in range(len(x.seq) - 11))


def test_walks_by_region_equal_walks_over_the_whole_graph(spark):
    r = random.Random(4)
    seqs = ["".join(r.choice("ACGT") for _ in range(50)) for _ in range(8)]
    reads = [s[i : i + 30] for s in seqs for i in range(0, 21, 5) for _ in range(r.randrange(1, 4))]
    nodes = kmers.build_nodes(make(spark, reads), 9, 12).cache()
    assert nodes.count() > 1000
    level = nodes.where("k = 12").cache()
    starts = level.select(F.col("kmer").alias("seq")).union(spark.createDataFrame([("ACGTTGCAACGA",), (seqs[0][5:17],), ("ACG",)], "seq string"))
    bound = 900  # below the whole graph, above each region
    for run in (
        lambda n: cluster.max_coverage_contigs(nodes, starts, 9, n),
        lambda n: seeds.steady_contigs(level, starts.where("length(seq) = 12"), 0.3, n if n > bound else 200, drop_up_to=0),
        lambda n: seeds.assemble_all(nodes, 9, n),
    ):
        whole, parts = (sorted(map(tuple, run(n).collect())) for n in (10**6, bound))
        assert whole and parts == whole
    with pytest.raises(ValueError, match="region"):
        seeds.assemble_all(nodes, 9, 3)
    with pytest.raises(ValueError):
        seeds.extract_all(nodes, 7, 3)


def test_contour(spark):
    script = plots.contour_script(stats.log_statistics(kmers.count_kmers(make(spark, some_reads(1)), 2, 4)), "x")
    assert script.startswith("k <- c(2, 3, 4)") and "filled.contour" in script


def test_link_strength_levels(spark):
    got = spark.range(1).select(S.link_strength_level(F.lit(0.5), 0.05), S.link_strength_level(F.lit(1.0), 0.05), S.link_strength_level(F.lit(0.0), 0.05)).first()
    assert tuple(got) == (3, 127, 0)
