"""What the operators share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.staging import drop, drop_staged, shared_dir, stage, staged_path

__all__ = ["arrow_rows", "bucket", "connected_components", "drop", "drop_staged", "free_names", "shared_dir", "smallest_by_hash", "stage", "staged_path"]


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bucket(col: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n



def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def smallest_by_hash(rows: DataFrame, by: str, of: str, n: int, max_values: int = 1000) -> dict[object, list[tuple[int, object]]]:
    """For each value of by, its n smallest (hash, of) among rows(by, of) with distinct pairs, in order, on the driver.

    Values are counted first; a bound on the hash then lets through n rows of each and some deviations
    more, so no task ever gathers a whole value and the driver about n rows of each.
    """
    counts = rows.groupBy(by).count().limit(max_values + 1).collect()
    if len(counts) > max_values:
        raise ValueError(f"over {max_values} values of {by}; raise max_values")
    if not counts:
        return {}
    h, low = F.xxhash64(of), -(1 << 63)
    wanted = F.lit(False)
    for value, count in counts:
        bound = min((1 << 63) - 1, low + int((1 << 64) * min(1.0, (n + 8 * math.sqrt(n) + 16) / count)))
        wanted = wanted | ((F.col(by) == F.lit(value)) & (h <= F.lit(bound)))
    out: dict[object, list[tuple[int, object]]] = {value: [] for value, _ in counts}
    for value, key, hashed in rows.where(wanted).select(by, of, h.alias("h")).distinct().collect():
        out[value].append((hashed, key))
    return {value: sorted(found)[:n] for value, found in out.items()}
