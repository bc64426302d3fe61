"""Staged tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where that is unset, in local mode only.

    Anywhere else executors have no folder in common with the driver unless one is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="helixframe-")
    return _own[app]


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: With this a query leaves no shuffle files; else they stay until the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return a DataFrame that reads it.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation, and lets two consumers
    share one computation.
    """
    path = staged_path(df.sparkSession, label)
    with _set(df.sparkSession, CLEANED):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def stage_by(df: DataFrame, column: str, label: str, path: str | None = None, **options: str) -> tuple[DataFrame, str]:
    """stage, with a folder for each of a few values of column (column=value), and the path: a part can be deleted before
    the rest.  path: of a table staged before, to which df is added."""
    mode = "append" if path else "error"
    path = path or staged_path(df.sparkSession, label)
    with _set(df.sparkSession, CLEANED | {"spark.sql.maxConcurrentOutputFileWriters": "4"}):  # else rows are sorted by column first
        df.write.partitionBy(column).options(**options).mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: only those whose consumers are themselves written."""
    for df in staged:
        delete(df.sparkSession, df._staged_at)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged; results that still read it stop working."""
    delete(spark, f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
