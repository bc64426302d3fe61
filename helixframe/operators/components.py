"""Connected components by alternating stars, or in one task for small graphs (U4, H2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage

#: What one task may label alone: edges, and bytes of the node ids that they hold.
SMALL_EDGES, SMALL_BYTES = 200_000, 16 << 20


def _distinct(edges: DataFrame, label: str) -> DataFrame:
    return stage(edges.where("u != v").distinct(), label)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    """What tells whether a round has changed the edges: their number, two sums of hashes and the bytes of their ids."""
    h = F.xxhash64("u", "v")
    size = F.octet_length(F.col("u").cast("string")) + F.octet_length(F.col("v").cast("string"))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u")), F.coalesce(F.sum(size), F.lit(0))).first())


def _labelled(batches):
    """Batches of (u, v) that hold a whole graph -> (node, component), by handing the smallest label along the edges."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ends = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks()
    names = pc.unique(ends)
    names = names.take(pc.sort_indices(names))
    at = pc.index_in(ends, names).to_numpy(zero_copy_only=False)
    a, b = at[: t.num_rows], at[t.num_rows :]
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (label[a], label[b], a, b):
            np.minimum.at(label, side, least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 100, small_edges: int = SMALL_EDGES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(node, component) for every node of edges(src, dst): component is the smallest node it reaches.

    A graph of at most small_edges distinct edges, whose ids have at most small_bytes bytes together, is
    labelled in one task; both are counted first, and the result is the same either way.  Beyond that large and small stars alternate until every component is one star, in a number of rounds that grows
    with the logarithm of the nodes, long chains included; there are never more edges than at the start.
    Minima are aggregated before the shuffle and staged: a node with many edges is then hot on one side of
    a join of two plain shuffles, which adaptive execution splits.  Edges live in staged tables; three numbers a round reach the driver.
    Node ids may be of any type with an order.
    """
    now = _distinct(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "cc-edges")
    before = _mark(now)
    if before[0] <= small_edges and before[-1] <= small_bytes:
        kind = now.schema["u"].dataType.simpleString()
        return stage(now.coalesce(1).mapInArrow(_labelled, f"node {kind}, component {kind}"), "cc-small-graph")
    for _ in range(max_rounds):
        last = now
        middle = _distinct(_large_star(now), "cc-large")
        now = _distinct(_small_star(middle), "cc-small")
        after = _mark(now)
        drop(middle, last)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = after
    raise RuntimeError(f"components still change after {max_rounds} rounds")
