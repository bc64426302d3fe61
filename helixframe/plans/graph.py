"""KmerGraph: the operators as methods of one object, and the whole assembly."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import cluster, kmers, links, maintain, reads, stats
from ..sources import graphs
from .staging import stage


class Phases:
    """Names Spark's jobs by phase, for its UI, and keeps the seconds that each took.

    With a path, report() is written there as JSON whenever a phase begins or ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.now, self.seconds = spark, path, None, {}

    def report(self) -> dict:
        """The present phase, seconds by phase, active stages with their tasks, and MB of memory by executor."""
        sc = self.spark.sparkContext
        tracker = sc.statusTracker()
        stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x is not None]
        memory = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().getExecutorMemoryStatus())
        return {
            "application": sc.applicationId,
            "phase": self.now,
            "seconds": {k: round(v, 1) for k, v in self.seconds.items()},
            "stages": [{"id": x.stageId, "name": x.name, "tasks": x.numTasks, "active": x.numActiveTasks, "done": x.numCompletedTasks, "failed": x.numFailedTasks} for x in stages],
            "executors": {str(e): {"most_mb": m._1() >> 20, "free_mb": m._2() >> 20} for e, m in memory.items()},
        }

    def _write(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps(self.report(), indent=1))

    @contextlib.contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began, self.now = time.monotonic(), name
        self._write()
        self.spark.sparkContext.setJobDescription(name)
        try:
            yield
        finally:
            self.spark.sparkContext.setJobDescription(None)
            self.seconds[name] = self.seconds.get(name, 0) + time.monotonic() - began
            self.now = None
            self._write()


class KmerGraph:
    """A node table and what one asks of it; methods that change the graph return another one."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def from_reads(cls, source: DataFrame, min_k: int = 2, max_k: int = 12) -> KmerGraph:
        return cls(stage(kmers.build_nodes(source, min_k, max_k), "nodes"))

    @classmethod
    def from_sequence(cls, spark: SparkSession, seq: str) -> KmerGraph:
        """One sequence, up to its own length."""
        source = spark.createDataFrame([(0, seq)], "read_id long, seq string").select("read_id", S.normalise("seq").alias("seq"))
        return cls.from_reads(source, 2, min(len(seq), kmers.MAX_K))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KmerGraph:
        return cls(graphs.load_graph(spark, path))

    def save(self, path: str) -> None:
        graphs.save_graph(kmers.compact(self.nodes), path)

    def clean(self, min_k: int) -> KmerGraph:
        return KmerGraph(stage(maintain.clean(self.nodes, min_k), "nodes-clean"))

    def show(self, k: int | None = None) -> DataFrame:
        return graphs.describe(self.nodes, k)

    def find(self, seq: str) -> DataFrame:
        return links.find(self.nodes, self.nodes.sparkSession.createDataFrame([(seq,)], "seq string").select(S.normalise("seq").alias("seq")))

    def neighbours(self) -> DataFrame:
        return links.neighbours(self.nodes)

    def statistics(self) -> DataFrame:
        return stats.coverage_totals(self.nodes)

    def subtract(self, amounts: DataFrame) -> KmerGraph:
        left = maintain.subtract_coverage(self.nodes, amounts)
        return KmerGraph(self.nodes.drop("coverage").join(left, ["k", "kmer"]).select("k", "kmer", "coverage", "edges", "is_palindrome"))

    def clusters(self, min_k: int, cutoff: float = cluster.CUTOFF) -> DataFrame:
        return cluster.clusters(self.nodes, min_k, cutoff)

    def unitigs(self, k: int) -> DataFrame:
        return cluster.unitigs(self.nodes, k)

    def extract(self, seed: str, min_k: int) -> DataFrame:
        seeds = self.nodes.sparkSession.createDataFrame([(seed,)], "seq string")
        return cluster.max_coverage_contigs(self.nodes, seeds, min_k)


def assemble(
    source: DataFrame, min_k: int = 30, max_k: int = 64, quality: int | str | None = None, trim_n: bool = True, min_contig: int = 200, max_rounds: int = 0x10000000, phases: Phases | None = None
) -> DataFrame:
    """The whole pipeline: trim, filter, count, prune, cluster, merge, contigs longer than min_contig."""
    spark = source.sparkSession
    phases = phases or Phases(spark)
    with phases.phase("trim, filter and count"):
        usable = reads.longer_than(reads.trim(source, trim_n, quality), min_k)
        graph = KmerGraph.from_reads(usable.select("read_id", S.normalise("seq").alias("seq")), max(2, min_k), max_k)
    with phases.phase("prune"):
        graph = graph.clean(min_k)
    with phases.phase("cluster"):
        groups = stage(cluster.settled_groups(graph.clusters(min_k), min_k), "groups")
    with phases.phase("merge"):
        groups = cluster.merge_groups(graph.nodes, groups, min_k, max_rounds)
    return cluster.contigs(groups, min_k, min_contig).orderBy(F.col("length").desc(), "group_id")
