"""Operator 9, chat formatting, in DataFrame functions only: cumulative-snapshot collapse, then rendering.

Logs often hold a conversation once after every exchange.  A conversation whose turns are the first
turns of a longer one is dropped; of conversations with equal turns the smallest conv_id stays.

A prefix is identified by 128 bits: the exclusive or, over its turns, of two hashes of (position, role,
text).  It is rolled over the turns in a window of short rows (ids and hashes, not texts).  Proper
prefixes are de-duplicated before they meet the conversations in an anti-join, whose sides then hold
every hash once: a first turn that a third of the conversations share is one row.  Texts are shuffled
once, to be rendered, and only those of the conversations that stay.

A conversation becomes one value, so its turns meet in one task; nothing else does.

Edge cases: turns are ordered by turn, role, md5 of the text, nulls first, for the hashes and for rendering
alike, and positions are counted, so gaps and repeated turn numbers do no harm; null roles and texts are told apart from empty ones in comparisons
and rendered as empty; rows with a null conv_id are one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, position, h1, h2, n): hashes of each prefix, n turns in all."""
    body = F.struct("role", "text")  # null fields leave the running hash as it is, so a mark is added
    marks = F.concat(F.isnull("role").cast("string"), F.isnull("text").cast("string"))
    short = turns.select("conv_id", "turn", "role", F.xxhash64(marks, body).alias("a"), F.xxhash64(F.lit("b"), marks, body).alias("b"), F.md5("text").alias("tie"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "tie")
    numbered = short.withColumn("position", F.row_number().over(order))
    rolled = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return numbered.select(
        "conv_id",
        "position",
        F.bit_xor(F.xxhash64("position", "a", "b")).over(rolled).alias("h1"),
        F.bit_xor(F.xxhash64("b", "position", "a")).over(rolled).alias("h2"),
        F.count(F.lit(1)).over(W.partitionBy("conv_id")).alias("n"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one continues or repeats."""
    prefixes = stage(prefix_hashes(turns), "chat-prefixes")
    whole = prefixes.where("position = n").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("position < n").select("position", "h1", "h2").distinct()
    return whole.join(proper, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"))


def rendered(turns: Column) -> Column:
    """An array of structs with role and text as one string."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(f"{CLOSE}\n"))), ""
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, n_turns, rendered) of the maximal conversations."""
    stay = maximal_conversations(turns)
    rows = turns.select("conv_id", F.struct("turn", "role", F.md5("text").alias("tie"), "text").alias("t"))
    kept = rows.join(stay.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return kept.select("conv_id", "n_turns", rendered(F.col("ts")).alias("rendered"))


def oracle() -> str:
    """DuckDB SQL for format_chats, comparing whole lists of turns instead of hashes."""
    return f"""WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS ts,
  string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, ts, any_value(rendered ORDER BY conv_id) AS rendered FROM c GROUP BY ts),
p AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM u))
SELECT conv_id, len(ts)::BIGINT AS n_turns, rendered FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = u.ts)"""
