"""Operator 2, mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source with share p of the tokens gets a weight proportional to p ** t.  The
exponent t is bisected in [0, 1]: to the flattest mix in which no source is repeated more than
``max_repeats`` times, or to ``target_entropy`` (nats) of the weights.  The budget is one pass over the
largest source unless ``budget`` (tokens) is given, so nothing is left out by default.

A source's weight times the budget over its tokens is the number of passes.  A document belongs to one
block for good (the first digits of md5 of seed and id), and a block is read through in one order.  Every
pass is a permutation of the blocks, by md5 of seed, pass and block; whole passes take all of them, the
last takes blocks in its order until the budget is filled.  The block in which that happens is cut by
document: first by sub-block (the next digits), so only one sub-block of each source is ever sorted.

Tokens are words, runs of anything but whitespace.  The number of sources is checked against
``max_sources``; that bound is what allows sending the table of sources to all tasks.

Edge cases: null sources are one source of their own; documents and sources without tokens appear in
every whole pass and in a first pass at least; equal doc_ids of a source stand together in every pass; a
null doc_id is hashed as empty; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, stage

STEPS = 60
#: Of the hash by which a pass orders its blocks.
TURN_DIGITS = 12


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisect_exponent(tokens: list[int], max_repeats: float = 4.0, target_entropy: float | None = None, budget: int | None = None) -> float:
    """The exponent for sources of so many tokens (zeros are ignored)."""
    sizes = [t for t in tokens if t > 0]
    if not sizes:
        return 1.0
    top, total = max(sizes), sum(sizes)

    def too_flat(t: float) -> bool:
        parts = [(s / top) ** t for s in sizes]
        whole = sum(parts)
        if target_entropy is not None:
            return -sum(p / whole * math.log(p / whole) for p in parts) > target_entropy
        scale = 1.0 if budget is None else budget / (top * whole)
        return max(scale * p * top / s for p, s in zip(parts, sizes, strict=True)) > max_repeats * max(1.0, (budget or 0) / total)

    if not too_flat(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_flat(mid) else (lo, mid)
    return hi


def mixing_plan(sized: DataFrame, max_repeats: float, target_entropy: float | None, budget: int | None, seed: str, block_digits: int, max_sources: int) -> DataFrame:
    """sized(doc_id, source, n_tokens) -> (source, passes, last_key): passes whole passes, then keys up to last_key."""
    totals = stage(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    rows = totals.select("tokens").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources; merge rare ones first or raise max_sources")
    sizes = sorted(r.tokens for r in rows if r.tokens)
    t = bisect_exponent(sizes, max_repeats, target_entropy, budget)
    top = max(sizes, default=1)
    scale = 1.0 if budget is None else budget / (top * sum((s / top) ** t for s in sizes)) if sizes else 1.0
    wanted = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(float(top)), F.lit(t - 1)) * F.lit(scale), 6)).otherwise(F.lit(1.0))
    plan = totals.select("source", "tokens", wanted.alias("wanted")).select("source", F.floor("wanted").alias("passes"), F.floor(F.round((F.col("wanted") - F.floor("wanted")) * F.col("tokens"), 3)).alias("rest"))
    part = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"]).where("rest > 0")
    key = document_key(seed, F.col("doc_id"))
    part = part.select("source", "rest", "n_tokens", key.alias("key"), F.left(key, F.lit(block_digits)).alias("block"), F.substring(key, block_digits + 1, block_digits).alias("sub"), "passes")
    part = part.withColumn("turn", block_turn(seed, F.col("passes"), F.col("block")))

    def last_started(groups: DataFrame, name: str) -> DataFrame:
        """Of groups(source, rest, base, <name>, tokens), in order, the last that starts within the budget, and where: all before it fit."""
        order = W.partitionBy("source").orderBy(name)
        begins = groups.withColumn("before", F.col("base") + F.sum("tokens").over(order) - F.col("tokens")).where(F.col("before") <= F.col("rest"))
        return begins.groupBy("source").agg(F.max(F.struct(name, "before")).alias("c")).select(F.col("source").alias("of"), F.col(f"c.{name}").alias(f"cut_{name}"), F.col("c.before").alias("base"))

    def inside(rows: DataFrame, cut: DataFrame, name: str) -> DataFrame:
        return rows.drop("base").join(F.broadcast(cut), rows["source"].eqNullSafe(cut["of"]) & (rows[name] == cut[f"cut_{name}"])).drop("of")

    cut = last_started(part.groupBy("source", "rest", "turn").agg(F.sum("n_tokens").alias("tokens")).withColumn("base", F.lit(0).cast("long")), "turn")
    block = inside(part, cut, "turn")
    subs = last_started(block.groupBy("source", "rest", "base", "sub").agg(F.sum("n_tokens").alias("tokens")), "sub")
    running = F.col("base") + F.sum("n_tokens").over(W.partitionBy("source").orderBy("key"))
    upto = inside(block, subs, "sub").withColumn("upto", running).where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max("key").alias("last")).select(F.col("source").alias("in"), "last")
    # a document of the sub-block, or what stands before the sub-block, or before the block
    ends = cut.select("of", "cut_turn").join(subs.select(F.col("of").alias("s"), "cut_sub"), F.col("of").eqNullSafe(F.col("s")), "left").join(upto, F.col("of").eqNullSafe(F.col("in")), "left")
    prefix = F.concat(F.substring("cut_turn", TURN_DIGITS + 1, block_digits), F.col("cut_sub"))
    ends = ends.select("of", F.concat(F.left("cut_turn", F.lit(TURN_DIGITS)), F.lit("-"), F.coalesce("last", prefix, F.lit(""))).alias("last_key"))
    return stage(plan.join(F.broadcast(ends), plan["source"].eqNullSafe(ends["of"]), "left").select("source", "passes", "last_key"), "mix-plan")


def document_key(seed: str, doc_id: Column) -> Column:
    """Where a document stands in every pass: its block's digits come first."""
    return F.md5(F.concat_ws("-", F.lit(seed), doc_id.cast("string")))


def block_turn(seed: str, number: Column, block: Column) -> Column:
    """Where a block stands in a pass; the block's own digits at the end tell equal hashes apart."""
    return F.concat(F.left(F.md5(F.concat_ws("-", F.lit(seed), number.cast("string"), block)), F.lit(TURN_DIGITS)), block)


def mix_sources(
    docs: DataFrame, max_repeats: float = 4.0, target_entropy: float | None = None, budget: int | None = None, seed: str = "mix", block_digits: int = 3, max_sources: int = 10_000
) -> DataFrame:
    """docs(doc_id, source, text, ...) once for each pass that takes it, with epoch, block, order_key, n_tokens.

    Reading order: epoch, then order_key, in which the documents of a block stand together.  Rows are not shuffled.
    """
    counted = docs.drop("epoch", "block", "order_key", "n_tokens").withColumn("n_tokens", token_count(F.col("text")))
    sized = stage(counted.select("doc_id", "source", "n_tokens"), "mix-sized")
    of, passes, last = free_names(counted, "of", "passes", "last_key")
    plan = mixing_plan(sized, max_repeats, target_entropy, budget, seed, block_digits, max_sources).toDF(of, passes, last)
    rows = counted.join(F.broadcast(plan), counted["source"].eqNullSafe(plan[of])).drop(of)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(passes))))
    key = document_key(seed, F.col("doc_id"))
    rows = rows.withColumn("block", F.left(key, F.lit(block_digits)))
    rows = rows.withColumn("order_key", F.concat(F.left(block_turn(seed, F.col("epoch"), F.col("block")), F.lit(TURN_DIGITS)), F.lit("-"), key))
    return rows.where((F.col("epoch") < F.col(passes)) | (F.col("order_key") <= F.col(last))).drop(passes, last)


def oracle() -> str:
    """DuckDB SQL for mix_sources with its defaults (no text): whole sources are sorted there."""
    flat = "pow(mn / top, {}) * top / mn > 4.0"
    half = flat.format("(lo + hi) / 2")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
x AS (SELECT max(tokens)::DOUBLE AS top, (min(tokens) FILTER (tokens > 0))::DOUBLE AS mn FROM t),
b(k, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN {half} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {half} THEN hi ELSE (lo + hi) / 2 END FROM b, x WHERE k < {STEPS}),
e AS (SELECT top, CASE WHEN {flat.format(0)} THEN (SELECT hi FROM b WHERE k = {STEPS}) ELSE 0 END AS t FROM x),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / top, t - 1), 6) ELSE 1.0 END AS wanted FROM t, e),
p AS (SELECT source, floor(wanted)::BIGINT AS passes, floor(round((wanted - floor(wanted)) * tokens, 3))::BIGINT AS rest FROM w),
a AS (SELECT d.*, passes, rest, unnest(range(0, passes + 1)) AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
h AS (SELECT *, md5('mix-' || doc_id) AS h FROM a),
k AS (SELECT *, left(md5('mix-' || epoch || '-' || left(h, 3)), 12) || '-' || h AS order_key FROM h),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY order_key) AS upto FROM k)
SELECT doc_id, source, epoch, left(h, 3) AS block, order_key, n_tokens FROM r WHERE epoch < passes OR (rest > 0 AND upto <= rest)"""
