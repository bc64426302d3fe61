"""Command line: assemble, refcompare, rmdup, show, find, statistics, picture, and scripts of such lines."""

from __future__ import annotations

import argparse
import contextlib
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import cluster, kmers, reads, stats
from .plans.graph import KmerGraph, Phases
from .plans.staging import stage
from .sources import fastx, graphs


def cutoff(text: str) -> int | str:
    """A quality as a number or as its character."""
    return int(text) if text.lstrip("-").isdigit() and len(text) > 1 or text.isdigit() else text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    jobs = top.add_subparsers(dest="job", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("files", nargs="*", help="reads, - for standard input; two files are mates")
    both.add_argument("-m", "--max-k", type=int, default=kmers.MAX_K)
    both.add_argument("--no-trimN", dest="trim_n", action="store_false")
    both.add_argument("-T", "--trimQ", dest="trim_q", type=cutoff)
    both.add_argument("-d", "--save-graph")
    both.add_argument("-L", "--load-graph")
    a = jobs.add_parser("assemble", parents=[both])
    a.add_argument("-k", "--min-k", type=int, default=30)
    a.add_argument("-r", "--max-rounds", type=int, default=0x10000000)
    a.add_argument("-l", "--min-contig-length", type=int, default=200)
    a.add_argument("-s", "--statistics", help="folder for tables")
    a.add_argument("--status", help="file that shows the phase, stages and memory while it runs")
    a.add_argument("-o", "--output", required=True)
    c = jobs.add_parser("refcompare", parents=[both])
    c.add_argument("-k", "--min-k", type=int, default=2)
    c.add_argument("-r", "--references", nargs="+", required=True)
    c.add_argument("-o", "--output", required=True)
    d = jobs.add_parser("rmdup")
    d.add_argument("-i", "--input", nargs=2, required=True)
    d.add_argument("-o", "--output", nargs=2, required=True)
    d.add_argument("-Q", "--quality-offset", type=int, default=-1, help="join the qualities of duplicates")
    for name, text in (("show", "nodes in readable form"), ("find", "one node"), ("statistics", "number of nodes and their coverage"), ("picture", "vertices and arcs as Parquet")):
        g = jobs.add_parser(name, help=text, parents=[both])
        g.add_argument("-k", "--min-k", type=int, default=2)
        if name == "show":
            g.add_argument("-n", "--rows", type=int, default=20)
        elif name == "find":
            g.add_argument("-S", "--sequence", required=True)
        elif name == "picture":
            g.add_argument("-o", "--output", required=True)
    f = jobs.add_parser("script", help="run a file of commands, one a line; # begins a comment, quotes hold words together")
    f.add_argument("file", help="- for standard input")
    return top


def load_reads(spark: SparkSession, files: list[str], trim_n: bool, trim_q: int | str | None, min_k: int) -> DataFrame:
    """Trimmed reads of more than min_k bases; two files are mates, whose duplicates count once."""
    files = [fastx.spool(spark, sys.stdin.buffer) if f == "-" else f for f in files]
    if len(files) == 2:
        pairs = reads.unique_pairs(fastx.read_pairs(spark, *files))
        rows = pairs.select(F.col("pair_id").alias("read_id"), F.explode(F.array("s1", "s2")).alias("seq"))
    else:
        rows = fastx.read_fastx(spark, files[0]).withColumn("read_id", F.monotonically_increasing_id())
    return reads.longer_than(reads.trim(rows, trim_n, trim_q), min_k).select("read_id", S.normalise("seq").alias("seq"))


def graph_of(spark: SparkSession, o: argparse.Namespace) -> KmerGraph:
    if o.load_graph:
        return KmerGraph.load(spark, o.load_graph)
    return KmerGraph.from_reads(load_reads(spark, o.files, o.trim_n, o.trim_q, o.min_k), max(2, o.min_k), o.max_k)


def assemble(spark: SparkSession, o: argparse.Namespace) -> None:
    phases = Phases(spark, o.status)
    with phases.phase("build and prune"):
        graph = graph_of(spark, o).clean(o.min_k)
    if o.save_graph:
        graph.save(o.save_graph)
    if o.statistics:
        with phases.phase("statistics"):
            graphs.write_table(graphs.log_table(stats.log_statistics(graph.nodes)), f"{o.statistics}/log_statistics")
            graphs.write_table(graphs.link_table(stats.read_link_statistics(graph.nodes), stats.read_link_histogram(graph.nodes)), f"{o.statistics}/read_connection_statistics")
            graphs.write_table(graphs.child_table(stats.child_statistics(graph.nodes), stats.child_summary(graph.nodes)), f"{o.statistics}/kmer_child_statistics")
            graphs.write_table(stats.coverage_histogram(graph.nodes).orderBy("coverage"), f"{o.statistics}/coverage_histogram")
    with phases.phase("assemble"):
        groups = stage(cluster.settled_groups(graph.clusters(o.min_k), o.min_k), "groups")
        merged = cluster.merge_groups(graph.nodes, groups, o.min_k, o.max_rounds)
        fastx.write_text(fastx.contig_text(cluster.contigs(merged, o.min_k, o.min_contig_length)), o.output)
    for name, seconds in phases.seconds.items():
        print(f"{name}: {seconds:.1f} s", file=sys.stderr)


def refcompare(spark: SparkSession, o: argparse.Namespace) -> None:
    graph = graph_of(spark, o)
    if o.save_graph:
        graph.save(o.save_graph)
    refs = None
    for path in o.references:
        one = fastx.read_fastx(spark, path, ("seq",)).select(F.lit(path).alias("ref_id"), S.normalise("seq").alias("seq"))
        refs = one if refs is None else refs.union(one)
    ks = [r.k for r in graph.nodes.select("k").distinct().orderBy("k").collect()]  # 253 at most
    graphs.write_table(stats.reference_comparison(graph.nodes, refs, ks).orderBy("ref_id", "k"), o.output)


def rmdup(spark: SparkSession, o: argparse.Namespace) -> None:
    pairs = fastx.read_pairs(spark, *o.input)
    once = reads.unique_pairs_quality(pairs, o.quality_offset) if o.quality_offset > 0 else reads.unique_pairs(pairs)
    fastx.write_pairs(once.withColumnRenamed("pair_id", "name"), *o.output)


def show(spark: SparkSession, o: argparse.Namespace) -> None:
    graph_of(spark, o).show().orderBy("k", "kmer").show(o.rows, truncate=False)


def find(spark: SparkSession, o: argparse.Namespace) -> None:
    graph_of(spark, o).find(o.sequence).show(truncate=False)


def statistics(spark: SparkSession, o: argparse.Namespace) -> None:
    graph_of(spark, o).statistics().show(truncate=False)


def picture(spark: SparkSession, o: argparse.Namespace) -> None:
    graphs.save_picture(graph_of(spark, o).nodes, o.output)


def script(spark: SparkSession, o: argparse.Namespace) -> None:
    """Line by line; "quit" ends it, a line that fails ends it with its error."""
    with contextlib.nullcontext(sys.stdin) if o.file == "-" else open(o.file) as lines:
        for line in lines:
            words = shlex.split(line, comments=True)
            if words == ["quit"]:
                return
            if words:
                print(f"> {line.strip()}", file=sys.stderr)
                run(spark, parser().parse_args(words))


#: Every command by its name.
COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {c.__name__: c for c in (assemble, refcompare, rmdup, show, find, statistics, picture, script)}


def run(spark: SparkSession, o: argparse.Namespace) -> None:
    COMMANDS[o.job](spark, o)


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    run(SparkSession.builder.appName(f"helixframe {o.job}").getOrCreate(), o)


if __name__ == "__main__":
    main()
