"""Operator 4, suffix-array dedup: a radix sort of suffixes through ``length`` bytes, most significant digit first.

Only equality through ``length`` bytes matters, so suffixes are ordered by digits and a suffix leaves
as soon as its digits so far are unique; groups still together after the last digit are exactly the
repeated windows.  The digits are chosen so that neighbouring suffixes share the work:

1. The first digit of the suffix at s is the smallest hash of a ``GRAM``-byte string inside its first
   ``length`` bytes (leftmost of equals).  Equal windows have equal first digits at equal distances, and
   consecutive suffixes mostly share theirs, so about one row in (length - GRAM) / 2 bytes is shuffled: a
   *run* of suffixes, with the digit ``h`` and a hash ``c`` of all bytes that the run's windows cover.
   Runs whose ``h`` occurs once are unique and leave.
2. Runs with equal (h, c) are equal throughout: repeated, whole.  Copies, however many, meet only as
   counts that are added before the shuffle.
3. Runs that share ``h`` but not ``c`` are compared window by window: one representative of each class
   carries its bytes to its group of equal ``h``, where all windows are hashed and sorted.  Groups of over
   ``max_classes`` classes are sorted by Spark instead, a row for each window, counted before the shuffle.

Hashes of windows have 64 bits and meet only where the first digit agrees.

Edge cases: null text is empty; texts shorter than ``length`` keep every byte; rows are told apart by
doc_id (null included) and text, so a repeated row repeats all its windows and both rows lose them; an
empty table gives an empty result; long texts are cut into overlapping slices, which changes runs, not
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage

GRAM = 64
SLICE = 1 << 19
PLACE = np.uint64((1 << 22) - 1)
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


class Roller:
    """64-bit hashes of all windows of a byte array, by prefix sums of byte values times powers."""

    def __init__(self, n: int):
        self.up = _powers(BASE, n)
        self.down = _powers(pow(BASE, -1, 1 << 64), n)
        values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    def windows(self, data: np.ndarray, size: int) -> np.ndarray:
        n = len(data) - size + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[size:] - sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values, from running minima of blocks in either direction."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first digit, first suffix, last suffix) of each run in data, whose pieces are [starts, ends)."""
    gram = min(GRAM, length)
    grams = roller.windows(np.frombuffer(data, dtype=np.uint8), gram)
    placed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (_smallest(placed, length - gram + 1) & PLACE).astype(np.int64)
    inside = np.zeros(len(at) + 1, dtype=np.int32)
    np.add.at(inside, np.minimum(starts, len(at)), 1)
    np.add.at(inside, np.clip(ends - length + 1, 0, len(at)), -1)
    suffix = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(suffix):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    digit = at[suffix]
    new = np.flatnonzero((np.diff(digit, prepend=-1) != 0) | (np.diff(suffix, prepend=-2) != 1))
    last = suffix[np.append(new[1:], len(suffix)) - 1]
    return grams[digit[new]], suffix[new], last


def _pieces(texts: list[bytes | None], length: int, most: int):
    """Lists of (row, offset, bytes) of about most bytes together; a longer text comes in slices that overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, most):
            piece = text[at : at + most + length - 1]
            if size + len(piece) > most + length and held:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def suffix_runs(docs: DataFrame, length: int, slice_bytes: int = SLICE) -> DataFrame:
    """docs(doc_id, th, data) -> (h, c, doc_id, th, start, size): the runs; size counts the bytes covered."""

    def run(batches):
        roller = Roller(2 * slice_bytes + 2 * length)
        for b in batches:
            ids, marks = b.column("doc_id"), b.column("th")
            out: dict[str, list] = {x: [] for x in ("h", "c", "row", "start", "size")}
            for pieces in _pieces(b.column("data").to_pylist(), length, slice_bytes):
                data = b"".join(p for _, _, p in pieces)
                ends = np.cumsum([len(p) for _, _, p in pieces])
                starts = ends - [len(p) for _, _, p in pieces]
                h, lo, hi = runs_of(data, starts, ends, length, roller)
                which = np.searchsorted(ends, lo, side="right")
                size = hi - lo + length
                digest = xxhash.xxh3_64_intdigest
                out["c"].append(np.fromiter((digest(data[s : s + n]) for s, n in zip(lo.tolist(), size.tolist(), strict=True)), dtype=np.uint64, count=len(lo)))
                out["h"].append(h)
                out["row"].append(np.array([r for r, _, _ in pieces])[which])
                out["start"].append(lo - starts[which] + np.array([at for _, at, _ in pieces])[which])
                out["size"].append(size)
            if not out["h"]:
                continue
            joined = {k: np.concatenate(v) for k, v in out.items()}
            rows = pa.array(joined["row"])
            arrays = [pa.array(joined["h"].view(np.int64)), pa.array(joined["c"].view(np.int64)), ids.take(rows), marks.take(rows), pa.array(joined["start"], pa.int64()), pa.array(joined["size"], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "c", "doc_id", "th", "start", "size"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, th long, start long, size int")


def _windows(segments: list[bytes], length: int, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, segment, place in it) of every window of length bytes."""
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments])
    many = sizes - length + 1
    of = np.repeat(np.arange(len(segments)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return roller.windows(data, length)[place + np.repeat(np.cumsum(sizes) - sizes, many)], of, place


def _stretches(of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of a segment as (segment, first, last)."""
    new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1))
    return of[new], place[new], place[np.append(new[1:], len(of)) - 1]


def _compare(length: int):
    """Segments sorted by h -> intervals of windows that their group holds twice, for segments of one copy."""

    def spans(rows: pa.Table, roller: Roller) -> pa.RecordBatch | None:
        segments = rows.column("segment").to_pylist()
        if (size := sum(map(len, segments))) > len(roller.up):
            roller = Roller(size)
        hashes, of, place = _windows(segments, length, roller)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(hashes), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= (rows.column("copies").to_numpy() == 1)[of]
        if not twice.any():
            return None
        seg, first, last = _stretches(of[twice], place[twice])
        start = rows.column("start").to_numpy()[seg]
        take = pa.array(seg)
        arrays = [rows.column(x).combine_chunks().take(take) for x in ("doc_id", "th")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(start + first), pa.array(start + last + length)], ["doc_id", "th", "start", "stop"])

    def run(batches):
        roller, held = Roller(2 * SLICE), None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.nbytes < SLICE:
                continue
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(-(h[::-1] == h[-1]).astype(int), 0))  # rows of the last group
            if cut < len(h):
                for part in _split(held.slice(0, len(h) - cut)):
                    if (out := spans(part, roller)) is not None:
                        yield out
                held = held.slice(len(h) - cut)
        if held is not None and held.num_rows:
            for part in _split(held):
                if (out := spans(part, roller)) is not None:
                    yield out

    return run


def _split(rows: pa.Table):
    """Parts of about SLICE bytes that hold whole groups."""
    h = rows.column("h").to_numpy()
    sizes = np.cumsum(np.array([len(x) for x in rows.column("segment").to_pylist()]))
    ends = np.append(np.flatnonzero(np.diff(h)) + 1, len(h))
    lo, base = 0, 0
    for i, e in enumerate(ends.tolist()):
        nxt = ends[i + 1] if i + 1 < len(ends) else None
        if nxt is None or sizes[nxt - 1] - base > SLICE:
            yield rows.slice(lo, e - lo)
            lo, base = e, int(sizes[e - 1])


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(h, c, doc_id, th, start, size, copies, classes) with the bytes that each covers."""
    listed = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "c", "start", "size", "copies", "classes")).alias("runs"))
    listed = listed.select(F.col("doc_id").alias("of"), F.col("th").alias("mark"), "runs")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, t, data, runs in zip(*(b.column(x).to_pylist() for x in ("doc_id", "th", "data", "runs")), strict=True):
                for r in runs:
                    for col, v in zip(cols, (r["h"], r["c"], i, t, r["start"], r["copies"], r["classes"], data[r["start"] : r["start"] + r["size"]]), strict=True):
                        col.append(v)
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["h", "c", "doc_id", "th", "start", "copies", "classes", "segment"])

    joined = docs.join(listed, docs["doc_id"].eqNullSafe(F.col("of")) & (docs["th"] == F.col("mark"))).select("doc_id", "th", "data", "runs")
    return joined.mapInArrow(run, "h long, c long, doc_id long, th long, start long, copies long, classes long, segment binary")


def _by_rows(segments: DataFrame, length: int) -> DataFrame:
    """What _compare does, for groups too large for a task: a row for each window, sorted by Spark."""

    def explode(batches):
        for b in batches:
            parts = b.column("segment").to_pylist()
            if not parts:
                continue
            roller = Roller(sum(map(len, parts)) + length)
            hashes, of, place = _windows(parts, length, roller)
            take = pa.array(of)
            rest = [b.column(x).take(take) for x in ("h", "c", "doc_id", "th", "start", "copies")]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *rest, pa.array(place)], ["w", "h", "c", "doc_id", "th", "start", "copies", "place"])

    rows = stage(segments.mapInArrow(explode, "w long, h long, c long, doc_id long, th long, start long, copies long, place long"), "suffix-windows")
    twice = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    found = rows.where("copies = 1").join(twice, "w", "left_semi")
    return found.select("doc_id", "th", (F.col("start") + F.col("place")).alias("start"), (F.col("start") + F.col("place") + length).alias("stop"))


def repeated_intervals(docs: DataFrame, length: int, max_classes: int, slice_bytes: int = SLICE) -> DataFrame:
    """docs(doc_id, th, data) -> (doc_id, th, start, stop) whose union is all that repeated windows cover."""
    runs = stage(suffix_runs(docs, length, slice_bytes), "suffix-runs")
    first = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1")
    # staged, so that the join below is one of two plain shuffles, whose hot digits adaptive execution splits
    first = stage(first.select("h", (F.col("low") != F.col("high")).alias("mixed")), "suffix-first")
    again = stage(runs.join(first, "h"), "suffix-again")
    mixed = again.where("mixed")
    one = F.min(F.struct("doc_id", "th", "start", "size")).alias("one")  # one row by construction, the same whenever it is computed
    classes = stage(mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), one).select("h", "c", "copies", "one.*"), "suffix-classes")
    groups = stage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")), "suffix-groups")
    # digits that a thousandth of the classes share, a thousand at most, go to the classes; the others meet theirs by a shuffle
    large = (groups.agg(F.sum("classes")).first()[0] or 0) // 1000 + 2
    hot = F.broadcast(groups.where(F.col("classes") >= large))
    sized = classes.join(hot, "h").unionByName(classes.join(hot, "h", "left_anti").join(groups.where(F.col("classes") < large), "h"))
    segments = stage(_segments(docs, sized), "suffix-segments")
    schema = "doc_id long, th long, start long, stop long"
    near = segments.where(F.col("classes") <= max_classes).repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), schema)
    # of classes that hold over a thousandth of the rows there are a thousand at most: those go to all tasks, unshuffled
    many = classes.where("copies > 1").select("h", "c", "copies")
    least = again.count() // 1000 + 2
    often = F.broadcast(many.where(F.col("copies") >= least).select("h", "c"))
    rest = mixed.join(often, ["h", "c"], "left_anti").join(many.where(F.col("copies") < least).select("h", "c"), ["h", "c"])
    whole = [again.where("NOT mixed"), mixed.join(often, ["h", "c"]), rest]
    out = near
    for w in whole:
        out = out.union(w.select("doc_id", "th", "start", (F.col("start") + F.col("size")).alias("stop")))
    if not groups.where(F.col("classes") > max_classes).isEmpty():
        out = out.union(_by_rows(segments.where(F.col("classes") > max_classes), length))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, max_classes: int = 20_000, slice_bytes: int = SLICE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): see the module's docstring.

    kept (binary) is what is left of the text; a cut may fall inside a character.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    if slice_bytes > SLICE:
        raise ValueError(f"slices of over {SLICE} bytes don't fit the place in a digit")
    arrow_rows(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")).withColumn("th", F.xxhash64("data"))
    found = repeated_intervals(rows, length, max_classes, slice_bytes)
    listed = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("away"))
    listed = listed.select(F.col("doc_id").alias("of"), F.col("th").alias("mark"), "away")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for data, away in zip(b.column("data").to_pylist(), b.column("away").to_pylist(), strict=True):
                spans, kept = merged([(x["start"], x["stop"]) for x in away or ()]), data
                if spans:
                    edges = [0, *(e for s in spans for e in s), len(data)]
                    kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                for col, v in zip(cols, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(listed, rows["doc_id"].eqNullSafe(F.col("of")) & (rows["th"] == F.col("mark")), "left").select("doc_id", "data", "away")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out
