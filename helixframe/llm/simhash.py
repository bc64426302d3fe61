"""Operator 5, SimHash near-duplicates: fingerprints, bit-sliced comparison inside blocks, components.

Two entry points share the machinery:

* ``simhash_components``: fingerprints that differ in at most ``radius`` (3) bits are linked.  Blocks:
  the 64 bits are cut into 5 pieces; two fingerprints within 3 bits agree on at least 2 pieces, so the
  10 pairs of pieces are keys of 25 or 26 bits that miss nothing.
* ``near_duplicates``: documents whose sets of ``words``-word shingles have a Jaccard similarity of at
  least ``similarity`` are linked.  Its fingerprints are of the shingle sets too, so repeats don't move
  them.  At 0.8 they differ in about 10 bits, too many for pieces, so the blocks are shared triples of
  smallest shingles: 18 triples, of which a pair at 0.8 shares none with probability 2.5e-6, a pair at 0.3
  one with 0.39, a pair at 0.1 one with 0.02.  The bit-sliced comparison runs inside blocks with radius 28;
  that loses a calculated 1e-6 of pairs at 0.8 in the worst case (sets of 4 and 5 shingles, a bit differs
  with probability 0.1875) and under 1e-8 of long ones; a lower similarity needs a wider one.  Then every
  link is decided on the exact shingle sets, inside the block that proposes it, and only links so verified
  make groups: loose candidates never chain.  The first two triples find nearly all of a group; the other
  sixteen then compare only what stands in a block with rows of another group.

Inside a block rows are held as vertical bit planes of 64 lanes; distances to all lanes are updated with
carry-save counters and lanes leave once they exceed the radius.  A block emits a tree for each group
that it finds (no more edges than rows), never its pairs.  Equal fingerprints are collapsed before
blocking.  A block of over ``chunk`` rows is cut into chunks and every pair of chunks is compared in a
task of its own, so no task holds more than two chunks.

Edge cases: null or wordless text has fingerprint zero and is linked like any other; rows that share a
doc_id are one document and join what each of them links to; a null doc_id keeps its row but is never the smallest id of a group; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, drop, stage

#: Fixed by the contract: bytes that separate words.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
CUTS = (0, 13, 26, 39, 52, 64)
PIECES = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(CUTS)]
MASKS = [a | b for a, b in itertools.combinations(PIECES, 2)]
#: Triples of smallest shingles, and how many of them are tried first.
BANDS, WIDTH, FIRST = 18, 3, 2
#: Odd and unrelated: multiples of one constant give minima that depend on each other and lose a thousandth of pairs.
SALTS = np.array([xxhash.xxh3_64_intdigest(f"salt {i}") | 1 for i in range(BANDS * WIDTH)], dtype=np.uint64)
MIX = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
EMPTY_SHINGLES = np.zeros(0, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of A-Z-lowered text, repeats included."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not found:
        return EMPTY_SHINGLES
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)), dtype=np.uint64, count=len(found) - words + 1)


def fingerprint(h: np.ndarray) -> int:
    """Bit 1 where set in over half of h; zero for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the unpacked copy of a very long text
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; text never leaves its task."""

    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(shingle_hashes(t, words))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def band_keys(u: np.ndarray) -> np.ndarray:
    """A hash of each triple of smallest values of u under three hash functions; none for an empty set."""
    if not len(u):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(SALTS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(u), 2048):  # bounds the table of a very long text
        least = np.minimum(least, (u[None, at : at + 2048] * SALTS[:, None]).min(axis=1))
    return (least.reshape(BANDS, WIDTH) * MIX[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, same, keys): the shingle set's fingerprint and band keys; same identifies the set."""

    def run(batches):
        for b in batches:
            fps, same, keys = [], [], []
            for t in b.column("text").to_pylist():
                u = np.unique(shingle_hashes(t, words))
                fps.append(_signed(fingerprint(u)))
                same.append(xxhash.xxh3_128_digest(u.tobytes()))
                keys.append(band_keys(u))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "same", "keys"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, same binary, keys array<long>")


def bit_sliced_pairs(fp: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) with fp within radius and b < last[a]; rows of a group are consecutive.

    Lanes: 64 consecutive rows make a block of 64 bit planes.  Row a is compared with the blocks from its
    own to that of last[a] - 1, all (row, block) combinations side by side.
    """
    n = len(fp)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, dtype=np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(blocks, 64, 8), axis=2)  # block, lane, bit
    planes = np.packbits(bits.transpose(2, 0, 1)[:, :, ::-1], axis=2).view(">u8").astype(np.uint64).reshape(64, blocks)
    first = np.arange(n) // 64
    many = np.where(last - 1 > np.arange(n), (last - 1) // 64 - first + 1, 0)
    lo, found = 0, []
    bounds = np.searchsorted(np.cumsum(many), np.arange(1 << 20, many.sum() + (1 << 20), 1 << 20))
    for hi in [*np.minimum(bounds + 1, n).tolist(), n]:
        if hi <= lo:
            continue
        row = np.repeat(np.arange(lo, hi), many[lo:hi])
        block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        lo = hi
        start = np.clip(row + 1 - block * 64, 0, 64)
        stop = np.clip(last[row] - block * 64, 0, 64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        below = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        live = below(stop) & ~below(start)
        row, block, live = (x[live != 0] for x in (row, block, live))
        counters = [np.zeros(len(row), dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        for p in range(64):
            carry = planes[p][block] ^ (np.uint64(0) - ((fp[row] >> np.uint64(63 - p)) & np.uint64(1)))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            live &= ~carry  # a counter ran over: far beyond the radius
            if p % 6 == 5 or p == 63:
                live &= ~_over(counters, radius)
                if (keep := live != 0).sum() < 0.7 * len(live) or p == 63:
                    row, block, live = row[keep], block[keep], live[keep]
                    counters = [c[keep] for c in counters]
            if not len(row):
                break
        if len(row):
            lanes = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(lanes)
            found.append((row[which], block[which] * 64 + lane))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds radius, compared from the highest bit plane down."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            over, equal = over | (equal & counters[k]), equal & ~counters[k]
    return over


def grouped_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n, given index pairs."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            break
    return label


def tree_edges(label: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component, member i to member (i - 1) // 2: connected, degree at most 3."""
    order = np.argsort(label, kind="stable")
    sorted_label, nodes = label[order], node[order]
    start = np.searchsorted(sorted_label, sorted_label, side="left")
    i = np.arange(len(order)) - start
    up = start + (i - 1) // 2
    return nodes[i > 0], nodes[up[i > 0]]


def _runs(batches, names: list[str], at_least: int = 1 << 16):
    """Tables that hold whole groups (equal names, rows come sorted), of about at_least rows."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < at_least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        keys = np.stack([t.column(x).to_numpy() for x in names])
        changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(changes):
            yield t.slice(0, changes[-1])
            held = [t.slice(changes[-1])]
        else:
            held = [t]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def _group_ends(t: pa.Table, names: list[str]) -> np.ndarray:
    keys = np.stack([t.column(x).to_numpy() for x in names])
    ends = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, t.num_rows)
    return np.repeat(ends, np.diff(ends, prepend=0))


def _in_chunks(rows: DataFrame, key: list[str], spread: str, chunk: int) -> DataFrame:
    """Rows of groups of two or more, with columns ci, cj: the pairs of chunks that a row takes part in."""
    # staged, so that the join is one of two plain shuffles, whose hot keys adaptive execution splits
    sizes = stage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "block-sizes")
    many = F.ceil(F.col("size") / chunk)
    own = F.pmod(F.xxhash64(spread), F.col("n"))
    return (
        rows.join(sizes, key)
        .withColumn("n", many)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("ci", F.least("own", "other"))
        .withColumn("cj", F.greatest("own", "other"))
        .drop("size", "n", "own", "other")
    )


def block_edges(rows: DataFrame, radius: int, chunk: int = 4096) -> DataFrame:
    """rows(t, key, fp, node) -> (src, dst): trees over what is within radius in the blocks (t, key)."""
    names = ["t", "key", "ci", "cj"]

    def run(batches):
        for t in _runs(batches, names):
            node = t.column("node").to_numpy()
            a, b = bit_sliced_pairs(t.column("fp").to_numpy().view(np.uint64), _group_ends(t, names), radius)
            src, dst = tree_edges(grouped_labels(len(node), a, b), node)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    spread = _in_chunks(rows, ["t", "key"], "node", chunk)
    return spread.repartition(*names).sortWithinPartitions(*names).select(*names, "fp", "node").mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id); see the module's docstring."""
    if not 0 <= radius <= 3:
        raise ValueError("pairs of the 5 pieces find all fingerprints within 3 bits only")
    fps = stage(fingerprints(docs, words), "fps")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "fp-nodes")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)])
    rows = nodes.select("fp", "node", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "node")
    groups = connected_components(block_edges(rows, radius))
    named = nodes.join(groups, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("of"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BLOCK = ["t", "key", "ci", "cj"]


def candidates(rows: DataFrame, radius: int, chunk: int) -> DataFrame:
    """Of rows(t, key, fp, node) those with another node's fingerprint within radius in their block."""

    def run(batches):
        for t in _runs(batches, BLOCK):
            a, b = bit_sliced_pairs(t.column("fp").to_numpy().view(np.uint64), _group_ends(t, BLOCK), radius)
            met = pa.array(np.unique(np.concatenate([a, b])))
            if len(met):
                yield t.take(met).combine_chunks().to_batches()[0].select(["t", "key", "fp", "node"])

    spread = _in_chunks(rows, ["t", "key"], "node", chunk).repartition(*BLOCK).sortWithinPartitions(*BLOCK).select(*BLOCK, "fp", "node")
    return spread.mapInArrow(run, "t int, key long, fp long, node long")


def verified_edges(rows: DataFrame, sets: DataFrame, similarity: float, radius: int, chunk: int) -> DataFrame:
    """rows(t, key, fp, node, grp), sets(node, shingles) -> (src, dst): exact links between rows of a block, trees over each group found.

    Nodes that share grp are linked already and not compared.
    """

    def run(batches):
        for t in _runs(batches, BLOCK, 2048):
            node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            ends = _group_ends(t, BLOCK)
            sets = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in t.column("shingles")]
            a, b = bit_sliced_pairs(fp, ends, radius)
            known = np.unique(np.stack([ends, t.column("grp").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
            group = np.unique(known, return_index=True)[1][known].tolist()  # the first row of the block in the same group

            def find(x: int) -> int:
                while group[x] != x:
                    group[x] = group[group[x]]
                    x = group[x]
                return x

            src, dst = [], []
            order = np.argsort(np.bitwise_count(fp[a] ^ fp[b]), kind="stable")
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                if (p := find(x)) == (q := find(y)):
                    continue
                small, large = sorted((len(sets[x]), len(sets[y])))
                if small < similarity * large:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= similarity * (small + large - both):
                    group[max(p, q)] = min(p, q)
                    src.append(node[x])
                    dst.append(node[y])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    several = stage(rows.groupBy("t", "key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low != high").select("t", "key"), "open-blocks")
    spread = _in_chunks(rows.join(several, ["t", "key"], "left_semi"), ["t", "key"], "node", chunk).join(sets, "node")
    return spread.repartition(*BLOCK).sortWithinPartitions(*BLOCK).select(*BLOCK, "fp", "node", "grp", "shingles").mapInArrow(run, "src long, dst long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column("text").to_pylist()]
            lengths = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            rest = [b.column(x) for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, arrays], [*(x for x in b.schema.names if x != "text"), "shingles"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    arrow_rows(docs.sparkSession, 256)
    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", shingles array<long>")


#: Bits of the filter for candidates; a broadcast of a row for every 64 at most.
FILTER = 1 << 25


def likely(rows: DataFrame, wanted: DataFrame, bits: int = FILTER) -> DataFrame:
    """Of rows(node, ...) those whose node is among wanted(node), and of the others at most a share of wanted / bits.

    Hashes are looked up in broadcast words of 64 bits, so rows are never shuffled, however many are wanted.
    """
    h = F.pmod(F.xxhash64("node"), F.lit(bits))
    word, bit = F.shiftright(h, 6), F.pmod(h, F.lit(64)).cast("int")
    words = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(words), "word").where(F.bit_get("bits", bit) == 1).drop("word", "bits")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = 1024, radius: int = 28) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, group_id): group_id is the smallest doc_id reachable over exact links.

    Rows with equal shingle sets are collapsed first, so copies cost nothing beyond their sketch.
    """
    found = stage(sketches(docs, words), "sketches")
    nodes = stage(found.groupBy("same").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("keys").alias("keys")).where("node IS NOT NULL"), "set-nodes")
    rows = stage(candidates(nodes.select("fp", "node", F.posexplode("keys").alias("t", "key")), radius, 4 * chunk).distinct(), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")  # a repeated row meets itself only, which is no link
    sets = stage(shingle_sets(likely(texts, rows.select("node")), words), "shingle-sets")
    arrow_rows(docs.sparkSession, 256)
    first = stage(verified_edges(rows.where(F.col("t") < FIRST).withColumn("grp", F.col("node")), sets, similarity, radius, chunk), "first-links")
    groups = connected_components(first)
    late = rows.where(F.col("t") >= FIRST).join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    groups = connected_components(first.union(verified_edges(late, sets, similarity, radius, chunk)))
    drop(rows, sets, first)
    named = nodes.join(groups, "node", "left").select(F.col("same").alias("of"), F.coalesce("component", "node").alias("group_id"))
    return found.join(named, F.col("same") == F.col("of"), "left").select("doc_id", "group_id")
