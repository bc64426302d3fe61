"""Operator 8, line dedup: levelled sorted runs of line hashes, compacted periodically.

``LineRuns`` keeps the corpus' line keys as runs (h1, h2, n_docs, max_doc), tables bucketed and sorted by
(h1, h2).  A batch is merge-anti-joined with the runs: the keys that none of them holds become a run of
level 0, so a key is in one run only; ``fanout`` runs of a level are compacted into one of the next, so a
key is rewritten only as often as there are levels.  Keys that a run holds already stay behind in the
batch and are added to its counts in the end.  Runs are joined in place, bucket by bucket: what is
shuffled is each batch, once, pre-aggregated, keys that come again once more, and runs only to be compacted.

``dedup_lines`` answers the corpus-wide question: keys of at least ``min_chars`` code points in at least
``min_docs`` documents lose their lines everywhere but in the largest doc_id.

Skew: keys are distinct within a document before anything is shuffled and counted map-side; keys that
hold over a thousandth of all (key, document) rows, of which there can be a thousand at most, are joined
by broadcast, the others by a shuffled join.

Edge cases: null or empty text is one empty line; an empty table gives an empty result; two rows with
one doc_id count as two documents and are edited alike; a row with a null doc_id counts, but is itself
never edited; other columns pass through, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, free_names, stage, staged_path

#: Fixed by the contract: what is stripped from both ends of a line.
STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """128-bit hash of each line's key, None where the key is shorter than min_chars code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(STRIP).lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): the distinct keys of each row of docs."""

    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                keys = {k for k in line_keys(t, min_chars) if k}
                found.extend(keys)
                ids.extend([i] * len(keys))
            h = [int.from_bytes(k[:8], "big", signed=True) for k in found], [int.from_bytes(k[8:], "big", signed=True) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(h[0], pa.int64()), pa.array(h[1], pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineRuns:
    """Sorted runs of line hashes in the shared folder, by level; see the module's docstring.

    The runs are tables of the session's catalog whose files lie in the shared folder, with as many buckets
    as spark.sql.shuffle.partitions has when the first one is written.
    """

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []
        self.name, self._written = f"line_runs_{uuid.uuid4().hex}", 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> DataFrame:
        name, self._written = f"{self.name}_{self._written}", self._written + 1
        rows.write.format("parquet").bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("path", staged_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def add(self, keys: DataFrame) -> None:
        """keys(h1, h2, doc_id), distinct within a document: those that are new become a run; full levels are compacted.

        A batch is written once, its new keys told from the others by a column: a task that writes to a local
        disk forks an executor several times for chmod, where Hadoop has no native library.
        """
        batch = keys.groupBy(*self.KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        held = F.lit(False)
        for i, run in enumerate(self._runs()):
            batch = batch.join(run.select(*self.KEY, F.lit(True).alias(f"in_{i}")).hint("merge"), [*self.KEY], "left")
            held = held | F.col(f"in_{i}").isNotNull()
        batch = self._write(batch.select(*self.KEY, "n_docs", "max_doc", held.alias("held")))
        if any(self.levels):
            self.again.append(batch.where("held").drop("held"))
        self._put(0, batch.where("NOT held").drop("held"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._summed(full)))

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        return self._union(runs).groupBy(*self.KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.union(r)
        return out

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over all that was added."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, max_doc long")
        if not self.again:
            return self._union(runs)
        more = self._summed(self.again).withColumnsRenamed({"n_docs": "more_docs", "max_doc": "more_max"})
        both = [r.join(more.hint("merge"), [*self.KEY], "left") for r in runs]
        return self._union([x.select(*self.KEY, (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "more_max").alias("max_doc")) for x in both])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys(h1, h2, ...) in no run: a merge anti-join with each run in turn."""
        for r in self._runs():
            keys = keys.join(r.hint("merge"), [*self.KEY], "left_anti")
        return keys

    def dedup_batch(self, batch: DataFrame, min_chars: int = 20) -> DataFrame:
        """Streaming use: lines of batch(doc_id, text) that earlier batches hold are dropped, the rest join the runs."""
        keys = stage(document_keys(batch, min_chars), "line-keys")
        seen = keys.join(stage(self.unseen(keys), "line-new"), ["h1", "h2", "doc_id"], "left_anti")
        out = without_lines(batch, seen, min_chars)
        self.add(keys)
        return out


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """docs without the lines in drops(h1, h2, doc_id), with n_lines and n_dropped.

    One document's keys to drop are collected: no more than its lines.
    """
    docs = docs.drop("n_lines", "n_dropped")
    of, away = free_names(docs, "of", "away")
    listed = drops.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("h1", "h2")).alias(away))
    joined = docs.join(listed, docs["doc_id"].cast("long") == F.col(of), "left").drop(of)
    schema = joined.drop(away).schema.add("n_lines", "long").add("n_dropped", "long")
    names = [f.name for f in schema][:-2]

    def run(batches):
        for b in batches:
            texts, n, gone = [], [], []
            for t, drop in zip(b.column("text").to_pylist(), b.column(away).to_pylist(), strict=True):
                if not drop:
                    texts.append(t)
                    n.append((t or "").count("\n") + 1)
                    gone.append(0)
                    continue
                gone_keys = {d["h1"].to_bytes(8, "big", signed=True) + d["h2"].to_bytes(8, "big", signed=True) for d in drop}
                lines = t.split("\n")
                keep = [line for line, k in zip(lines, line_keys(t, min_chars), strict=True) if k not in gone_keys]
                texts.append("\n".join(keep))
                n.append(len(lines))
                gone.append(len(lines) - len(keep))
            columns = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(x, b.column(x) if x in names else None) for x in [*names, "n_lines", "n_dropped"]], [*names, "n_lines", "n_dropped"])

    arrow_rows(docs.sparkSession)
    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, hot: int = 1000) -> DataFrame:
    """docs with a text and n_lines, n_dropped after dropping repeated lines; see the module's docstring.

    The keys enter the runs in ``batches`` parts, by a hash of the document, which costs one scan of the texts.
    """
    keys = stage(document_keys(docs, min_chars), "line-keys")
    runs = LineRuns(docs.sparkSession)
    for i in range(batches):
        runs.add(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    counts = runs.counts().coalesce(runs.buckets)  # a task for each bucket, not for each bucket of each run
    repeated = stage(counts.where(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", "max_doc"), "line-repeated")
    least = max(min_docs, keys.count() // hot + 1)  # so many rows of one key: at most `hot` keys have them
    often = F.broadcast(repeated.where(F.col("n_docs") >= least))
    rare = repeated.where(F.col("n_docs") < least)
    away = keys.join(often, ["h1", "h2"]).union(keys.join(often, ["h1", "h2"], "left_anti").join(rare, ["h1", "h2"]).select("h1", "h2", "doc_id", "n_docs", "max_doc"))
    return without_lines(docs, away.where("doc_id < max_doc").select("h1", "h2", "doc_id"), min_chars)


def line_digest(docs: DataFrame) -> DataFrame:
    """The contract of op8."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL for line_digest."""
    return r"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, line, i, r.last IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
