"""Spark's result and DuckDB's, compared as sorted rows of text."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return con


def text(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def same(spark_rows, columns, relation):
    order = sorted(columns)
    assert sorted(relation.columns) == order
    at = [relation.columns.index(c) for c in order]
    got = sorted([text(r[c]) for c in order] for r in spark_rows)
    want = sorted([text(r[i]) for i in at] for r in relation.fetchall())
    assert got == want
