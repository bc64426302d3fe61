"""Plain Python over the rows of one group after another, in Arrow batches.

A grouped pandas function costs some milliseconds a group; here groups arrive as runs of sorted rows, so
many small ones share a batch, and one group at a time is held.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 4096


def by_group(df: DataFrame, key: str, function: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """function(rows of a group, as named tuples) -> rows of schema, for each value of key."""
    names, at = df.columns, df.columns.index(key)
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches):
        row = namedtuple("row", names)
        group, done = [], []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and values[at] != group[0][at]:
                    done.extend(function(group))
                    group = []
                    if len(done) >= ROWS:
                        yield batch(done)
                        done = []
                group.append(row._make(values))
        if group:
            done.extend(function(group))
        if done:
            yield batch(done)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
