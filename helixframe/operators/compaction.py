"""Unitigs straight from reads, for odd k up to 15 (H16 at the documents' size).

1. Reads are cut into runs of neighbouring k-mers with one minimizer, each with the base before and after
   it, packed into 64 bits; equal runs of a task are counted before the shuffle.
2. All that is known of a k-mer meets where its minimizer is dealt to, so coverage and ways on are whole
   there, and chains inside a group of minimizers are put together: *pieces*.  A piece's end with one way
   on into another group is open and carries the (k + 1)-base string that leads there.
3. Pieces are glued in rounds: each goes to one of its open ends, that of the smaller hash, and sends word
   to the other.  Two that meet are joined, an end that nobody else names is closed.  The end of smallest
   hash always goes, about a third of all in a round; what is left is glued in one task once it is small.

Sequences are coded 2 bits a base, the first base lowest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import delete, stage_by
from . import walks

MER = 7
#: k-mers of a run at most: with k - 1 more bases and one at either side they fill 64 bits.
NODES = 16
SLICE = 1 << 20
#: Runs that a task counts together, and windows that a task expands together.
HELD_RUNS, HELD_WINDOWS = 3 << 20, 1 << 21
#: Windows that make a group of minimizers.
GROUP = 1 << 20
#: Open pieces that one task glues alone, counted first.
SMALL = 400_000
CLOSED = -1
#: Shares of a round of gluing.
PARTS = 3
#: Of staged pieces: bases pack to two bits each, and no two pieces are equal.
PACKED = {"compression": "zstd", "parquet.enable.dictionary#seq": "false", "parquet.enable.dictionary#l": "false", "parquet.enable.dictionary#r": "false"}
PIECE = "seq string, coverage long, l long, r long, open boolean"
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
_LETTER = np.frombuffer(b"ACGT", dtype=np.uint8)
_FLIP = np.arange(256, dtype=np.uint8)
_FLIP[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.frombuffer(b"TGCA", dtype=np.uint8)
_BITS = np.array([bin(x).count("1") for x in range(16)], dtype=np.uint8)
_BASE = np.array([max(0, x.bit_length() - 1) for x in range(16)], dtype=np.uint64)


def _rc(x: np.ndarray, k: int) -> np.ndarray:
    """Reverse complement of codes of k bases."""
    x = ~x.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    x = (x >> np.uint64(32)) | (x << np.uint64(32))
    return x >> np.uint64(64 - 2 * k)


def _ranks(mer: int) -> np.ndarray:
    """A rank for each string of mer bases, the same for both strands, in an order that has nothing to do with its letters."""
    codes = np.arange(4**mer, dtype=np.uint64)
    least = np.minimum(codes, _rc(codes, mer))
    mixed = (least + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed, return_inverse=True)[1].ravel().astype(np.uint16)


def _runs(codes: np.ndarray, ends: np.ndarray, k: int, mer: int, ranks: np.ndarray):
    """(minimizer, packed, meta) of the runs of reads that lie one after another in codes; meta: bases, and whether one stands before and after."""
    n = len(codes)
    starts = ends - np.diff(ends, prepend=0)
    padded = np.concatenate([codes, np.zeros(64, dtype=np.uint8)])
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        at = max(0, lo - 1)
        c = padded[at : hi + 48].astype(np.uint32)
        for w in (1, 2, 4, 8):
            c = c[:-w] | (c[w:] << np.uint32(2 * w))
        least = ranks[c & np.uint32(4**mer - 1)]
        width, have = k - mer + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        pos = np.arange(lo, hi)
        first = np.searchsorted(ends, pos[0], side="right")
        last = np.searchsorted(ends, pos[-1], side="right")
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.minimum(ends[first : last + 1], hi), prepend=lo))
        valid = pos + k <= ends[owner]
        least = least[lo - at : lo - at + len(pos)]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (owner[1:] == owner[:-1]))
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        stop = np.flatnonzero(np.append((~valid | new)[1:], True) & valid) + 1
        size = stop - begin
        parts = -(-size // NODES)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, size = np.repeat(begin, parts) + nth * NODES, np.minimum(NODES, np.repeat(size, parts) - nth * NODES)
        p, of = begin + lo, owner[begin]
        before, after = p > starts[of], p + size - 1 + k < ends[of]
        bases = size + (k - 1) + before + after
        from_ = p - before - at
        packed = c[from_].astype(np.uint64) | (c[from_ + 16].astype(np.uint64) << np.uint64(32))
        packed &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 2 * bases).astype(np.uint64)
        yield least[begin], packed, (bases | (before << 6) | (after << 7)).astype(np.uint8)


def _cut(k: int, mer: int):
    """Batches of seq -> (minimizer, runs): a row for each minimizer of what a task counts together."""

    def counted(held: list):
        b, packed, meta = (np.concatenate(x) for x in zip(*held, strict=True))
        low = (b.astype(np.uint32) << np.uint32(8)) | meta
        order = np.lexsort((packed, low))
        low, packed = low[order], packed[order]
        at = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (packed[1:] != packed[:-1])))
        count = np.diff(at, append=len(low)).astype(np.uint32)
        low, packed = low[at], packed[at]
        b = low >> np.uint32(8)
        cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        for lo in range(0, len(cuts) - 1, 512):
            some = list(zip(cuts[lo : lo + 512].tolist(), cuts[lo + 1 : lo + 513].tolist(), strict=False))
            planes = [packed[s:e].view(np.uint8).reshape(-1, 8).T.tobytes() for s, e in some]
            metas = [low[s:e].astype(np.uint8).tobytes() for s, e in some]
            counts = [count[s:e].view(np.uint8).reshape(-1, 4).T.tobytes() for s, e in some]
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts[lo : lo + len(some)]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in (planes, metas, counts))], ["b", "packed", "meta", "count"])

    def run(batches):
        ranks, held, many = _ranks(mer), [], 0
        for batch in batches:
            seqs = batch.column("seq").cast(pa.large_binary()).drop_null()
            if not len(seqs):
                continue
            offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
            codes = _CODE[np.frombuffer(seqs.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
            for runs in _runs(codes, offsets[1:] - offsets[0], k, mer, ranks):
                held.append(runs)
                many += len(runs[0])
                if many >= HELD_RUNS:
                    yield from counted(held)
                    held, many = [], 0
        if held:
            yield from counted(held)

    return run


def _summed(node: np.ndarray, mask: np.ndarray, cov: np.ndarray):
    order = np.argsort(node, kind="stable")
    node = node[order]
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    return node[at], np.bitwise_or.reduceat(mask[order], at), np.add.reduceat(cov[order], at)


def _nodes(packed: np.ndarray, meta: np.ndarray, count: np.ndarray, k: int):
    """(canonical k-mer, mask, coverage) of runs, each k-mer once; mask: bases after it in the low four bits, before it in the high ones."""
    size = (meta & 63) - ((meta >> 6) & 1) - (meta >> 7) - np.uint8(k - 1)
    order = np.argsort(np.uint8(255) - size, kind="stable")  # the longest first, so that each step takes a slice
    packed, meta, size = packed[order], meta[order], size[order]
    before, after = ((meta >> 6) & 1).astype(bool), (meta >> 7).astype(bool)
    # a count fits 24 bits, as a task counts fewer runs together
    low = count[order].astype(np.uint64)
    many = len(size) - np.searchsorted(size[::-1], np.arange(NODES), side="right")
    top, three = np.uint64(2 * (k - 1)), np.uint32(3)
    packed = np.where(before, packed, packed << np.uint64(2))  # a place for the base before: without one a run has 31 bases at most
    mask = np.uint32(4**k - 1)
    w = ((packed >> np.uint64(2)) & np.uint64(4**k - 1)).astype(np.uint32)
    back = _rc(w, k).astype(np.uint32)
    prior = (packed & np.uint64(3)).astype(np.uint32)
    out = []
    for i in range(NODES):
        n = int(many[i])
        if not n:
            break
        w, back, prior = w[:n], back[:n], prior[:n]
        at = min(2 * (i + 1 + k), 62)
        nxt = (packed[:n] >> np.uint64(at)).astype(np.uint32) & three
        has_before = before[:n].astype(np.uint32) if i == 0 else np.uint32(1)
        has_after = after[:n].astype(np.uint32)
        if i + 1 < NODES:
            has_after[: int(many[i + 1])] = 1
        flip = back < w
        on = np.where(flip, has_before << (three - prior), has_after << nxt)
        into = np.where(flip, has_after << (three - nxt), has_before << prior)
        out.append((np.minimum(w, back).astype(np.uint64) << np.uint64(32)) | ((on | (into << np.uint32(4))) << np.uint32(24)) | low[:n])
        prior = w & three
        w, back = (w >> np.uint32(2)) | (nxt << np.uint32(top)), ((back << np.uint32(2)) & mask) | (three - nxt)
    rows = np.concatenate(out)
    rows.sort()
    node = (rows >> np.uint64(32)).astype(np.uint32)
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    low = rows.astype(np.uint32)
    seen = (np.bitwise_or.reduceat(low, at) >> np.uint32(24)).astype(np.uint8)
    return node[at], seen, np.add.reduceat((low & np.uint32((1 << 24) - 1)).astype(np.int64), at)


def _chains(node: np.ndarray, mask: np.ndarray, cov: np.ndarray, k: int) -> pa.RecordBatch:
    """Pieces of the k-mers of a group.  A state is a k-mer on one strand; states are sorted by their codes, so those that go on by one base look their successors up in order."""
    n = len(node)
    codes = np.concatenate([node, _rc(node, k).astype(np.uint32)])
    order = np.argsort(codes)
    codes = codes[order]
    rank = np.empty(2 * n, dtype=np.int64)
    rank[order] = np.arange(2 * n)
    flip = rank[np.where(order < n, order + n, order - n)]
    at = np.where(order < n, order, order - n)
    high = mask >> 4
    ways = np.concatenate([mask & 15, ((high & 1) << 3) | ((high & 2) << 1) | ((high & 4) >> 1) | (high >> 3)])[order]  # complements, on the other strand
    single = _BITS[ways] == 1
    base = _BASE[ways].astype(np.uint32)
    nxt = np.full(2 * n, -1, dtype=np.int64)
    away = np.zeros(2 * n, dtype=bool)
    for c in range(4):
        some = np.flatnonzero(single & (base == c))
        goes = (codes[some] >> np.uint32(2)) | np.uint32(c << (2 * k - 2))
        to = np.minimum(np.searchsorted(codes, goes), 2 * n - 1)
        here = codes[to] == goes
        # the way back must be the only one too; a way to the k-mer itself is no link
        link = here & single[flip[to]] & (at[to] != at[some])
        nxt[some[link]] = to[link]
        away[some[~here]] = True
    name = np.full(2 * n, CLOSED, dtype=np.int64)
    some = np.flatnonzero(away)
    edge = codes[some].astype(np.uint64) | (base[some].astype(np.uint64) << np.uint64(2 * k))
    rest = (codes[flip[some]].astype(np.uint64) << np.uint64(2)) | (np.uint64(3) - base[some].astype(np.uint64))
    name[some] = np.minimum(edge, rest).astype(np.int64)
    # both ends of a chain begin it; all but single k-mers are followed from both, as only then their ends are known
    begun = np.flatnonzero(nxt[flip] < 0)
    begun = begun[(nxt[begun] >= 0) | (begun < flip[begun])]
    chain, cur = np.arange(len(begun)), begun
    ended, total, size = begun.copy(), np.zeros(len(begun), dtype=np.int64), np.zeros(len(begun), dtype=np.int64)
    met, steps, last = np.zeros(n, dtype=bool), [], np.uint32(2 * k - 2)
    while len(chain):
        where = at[cur]
        met[where] = True
        steps.append((chain, (codes[cur] >> last).astype(np.uint8)))
        total[chain] += cov[where]
        size[chain] += 1
        ended[chain] = cur
        cur = nxt[cur]
        live = np.flatnonzero(cur >= 0)
        chain, cur = chain[live], cur[live]
    kept = begun < flip[ended]
    rings = []
    for i in np.flatnonzero(~met).tolist():  # rings inside the group, one after the other
        if met[i]:
            continue
        line, s = [], int(rank[i])
        while not met[at[s]]:
            met[at[s]] = True
            line.append(s)
            s = int(nxt[s])
        text = "".join("ACGT"[int(codes[line[0]]) >> 2 * j & 3] for j in range(k)) + "".join("ACGT"[int(codes[s]) >> 2 * k - 2] for s in line[1:])
        rings.append((_opened(text, k), int(sum(cov[at[s]] for s in line))))
    offsets = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(np.where(kept, size + (k - 1), 0), out=offsets[1:])
    data = np.empty(int(offsets[-1]), dtype=np.uint8)
    first, begins = codes[begun[kept]], offsets[:-1][kept]
    for j in range(k - 1):
        data[begins + j] = (first >> np.uint32(2 * j)).astype(np.uint8) & 3
    for t, (of, letter) in enumerate(steps):
        mine = np.flatnonzero(kept[of])
        data[offsets[of[mine]] + (k - 1) + t] = letter[mine]
    seq = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, offsets[-1]).astype(np.int32)), pa.py_buffer(_LETTER[data]))
    pieces = _closed(seq, total[kept], name[flip[begun[kept]]], name[ended[kept]], k)
    if not rings:
        return pieces
    none = np.full(len(rings), CLOSED)
    more = _closed(pa.array([x for x, _ in rings]), np.array([x for _, x in rings]), none, none, k)
    return pa.Table.from_batches([pieces, more]).combine_chunks().to_batches()[0]


def _flipped(seq: pa.Array) -> pa.Array:
    """Reverse complements of strings."""
    seq = pa.concat_arrays([seq])
    if not len(seq) or seq.buffers()[2] is None:
        return seq
    data = _FLIP[np.frombuffer(seq.buffers()[2], dtype=np.uint8)]
    return pc.ascii_reverse(pa.Array.from_buffers(seq.type, len(seq), [None, seq.buffers()[1], pa.py_buffer(data)], offset=seq.offset))


def _opened(seq: str, k: int) -> str:
    """A ring, given by all its k-mers in order, cut before its smallest."""
    n = len(seq) - k + 1
    back = walks.rc(seq)
    best, text, i = min((t[i : i + k], t, i) for t in (seq, back) for i in range(n))
    ring = text[:n] * (3 + k // n)
    return ring[i : i + n + k - 1]


def _closed(seq: pa.Array, cov: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> pa.RecordBatch:  # noqa: E741
    """Pieces as rows: a piece whose ends lead to each other is a ring, what has no open end is final and canonical."""
    ring = (l == r) & (l != CLOSED)
    if ring.any():
        at = np.flatnonzero(ring)
        texts = seq.to_pylist()
        for i in at.tolist():
            texts[i] = _opened(texts[i], k)
        seq, l, r = pa.array(texts, seq.type), np.where(ring, CLOSED, l), np.where(ring, CLOSED, r)  # noqa: E741
    still = (l != CLOSED) | (r != CLOSED)
    back = _flipped(seq)
    seq = pc.if_else(pc.or_(pa.array(still), pc.less(seq, back)), seq, back)
    return pa.RecordBatch.from_arrays([seq, pa.array(cov, pa.int64()), pa.array(l, pa.int64()), pa.array(r, pa.int64()), pa.array(still)], ["seq", "coverage", "l", "r", "open"])


def _group(k: int, group: int):
    """Runs sorted by minimizer -> pieces; minimizers of about group windows together."""

    def expand(held: list):
        packed = np.concatenate([np.frombuffer(p, dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() for p, _, _ in held])
        meta = np.concatenate([np.frombuffer(m, dtype=np.uint8) for _, m, _ in held])
        count = np.concatenate([np.frombuffer(c, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for _, _, c in held])
        return _nodes(packed, meta, count, k)

    def run(batches):
        held, windows, done, whole, last = [], 0, [], 0, None

        def pieces():
            found = done + ([expand(held)] if held else [])
            node, mask, cov = found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            out = _chains(node, mask, cov, k)
            for lo in range(0, out.num_rows, 50_000):
                yield out.slice(lo, 50_000)

        for batch in batches:
            for b, p, m, c in zip(*(batch.column(x).to_pylist() for x in ("b", "packed", "meta", "count")), strict=True):
                if last is not None and b != last and whole >= group:
                    yield from pieces()
                    held, windows, done, whole = [], 0, [], 0
                last = b
                held.append((p, m, c))
                windows += 5 * len(m)
                whole += 5 * len(m)
                if windows >= HELD_WINDOWS:
                    done.append(expand(held))
                    held, windows = [], 0
                    if sum(len(x[0]) for x in done[1:]) > len(done[0][0]):
                        done = [_summed(*(np.concatenate(x) for x in zip(*done, strict=True)))]
        if held or done:
            yield from pieces()

    return run


def _glued(t: pa.Table, k: int) -> pa.RecordBatch:
    """One round over rows (key, seq, coverage, l, r) sorted by key, a null seq being word from a piece that went elsewhere."""
    t = t.combine_chunks()
    key = t.column("key").to_numpy()
    here = pc.is_valid(t.column("seq")).to_numpy()
    pair = np.append(key[1:] == key[:-1], False)
    second = np.append(False, pair[:-1])
    both = np.flatnonzero(pair & here & np.append(here[1:], False))
    l, r = t.column("l").to_numpy(), t.column("r").to_numpy()  # noqa: E741
    cov, seq = t.column("coverage").to_numpy(), t.column("seq").combine_chunks()
    seq = seq.chunk(0) if isinstance(seq, pa.ChunkedArray) else seq

    # alone: nobody else names the end, so it is closed
    waits = here & (pair | second)
    waits[both] = waits[both + 1] = False
    alone = here & ~(pair | second)
    l1, r1 = np.where(alone & (l == key), CLOSED, l), np.where(alone & (r == key), CLOSED, r)
    rest = np.flatnonzero(waits | alone)
    a, b = both, both + 1
    turn_a, turn_b = pa.array(l[a] == key[a]), pa.array(r[b] == key[b])
    sa, sb = seq.take(pa.array(a)), seq.take(pa.array(b))
    sa, sb = pc.if_else(turn_a, _flipped(sa), sa), pc.if_else(turn_b, _flipped(sb), sb)
    joined = pc.binary_join_element_wise(sa, pc.utf8_slice_codeunits(sb, k - 1), "")
    left, right = np.where(l[a] == key[a], r[a], l[a]), np.where(r[b] == key[b], l[b], r[b])
    return _closed(
        pa.concat_arrays([seq.take(pa.array(rest)), joined]),
        np.concatenate([cov[rest], cov[a] + cov[b]]),
        np.concatenate([l1[rest], left]),
        np.concatenate([r1[rest], right]),
        k,
    )


def _glue(k: int):
    """Rows sorted by key -> pieces."""

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _glued(t.slice(0, cut), k)
                t = t.slice(cut)
            held, many = t.to_batches(), t.num_rows
        if many:
            yield _glued(pa.Table.from_batches(held), k)

    return run


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _glue_all(k: int):
    """All open pieces -> pieces without open ends."""

    def run(batches):
        now, salt = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else None, 0
        while now is not None and now.num_rows:
            salt += 1
            l, r = now.column("l").to_numpy(), now.column("r").to_numpy()  # noqa: E741
            left = (r == CLOSED) | ((l != CLOSED) & (_mixed(l, salt) < _mixed(r, salt)))
            key, other = np.where(left, l, r), np.where(left, r, l)
            word = other[other != CLOSED]
            none = pa.nulls(len(word), pa.int64())
            cols = {x: pa.concat_arrays([now.column(x).combine_chunks(), pa.nulls(len(word), now.column(x).type) if x == "seq" else pc.fill_null(none, 0)]) for x in ("seq", "coverage", "l", "r")}
            keys = np.concatenate([key, word])
            t = pa.table({"key": keys, **cols}).take(pa.array(np.argsort(keys, kind="stable")))
            out = _glued(t, k)
            yield out.filter(pc.invert(out.column("open")))
            now = pa.Table.from_batches([out.filter(out.column("open"))])

    return run


def unitigs(reads: DataFrame, k: int, small: int = SMALL, group: int = GROUP) -> DataFrame:
    """reads(seq over A, C, G, T) -> (seq, length, n_nodes, coverage): what cluster.unitigs gives for the nodes of k and k + 1.

    All distinct k-mers of one minimizer meet in a task, and a unitig is one string.
    """
    if k % 2 == 0 or not 3 <= k <= 15:
        raise ValueError("k must be odd, 3 to 15")
    spark, mer = reads.sparkSession, min(MER, k)
    runs = reads.select("seq").mapInArrow(_cut(k, mer), "b int, packed binary, meta binary, count binary")
    now, path = stage_by(runs.repartition("b").sortWithinPartitions("b").mapInArrow(_group(k, group), PIECE), "open", "unitig-pieces", **PACKED)
    done, salt = [now.where("NOT open")], 0
    while (left := now.where("open").count()) > 0:
        salt += 1
        pieces = now.where("open")
        if left <= small:
            parts = [pieces.coalesce(1).mapInArrow(_glue_all(k), PIECE)]
        else:
            mine = (F.col("r") == CLOSED) | ((F.col("l") != CLOSED) & (F.xxhash64("l", F.lit(salt)) < F.xxhash64("r", F.lit(salt))))
            none = F.lit(0).cast("long")
            rows = pieces.select(F.when(mine, F.col("l")).otherwise(F.col("r")).alias("key"), "seq", "coverage", "l", "r")
            word = pieces.where((F.col("l") != CLOSED) & (F.col("r") != CLOSED)).select(F.when(mine, F.col("r")).otherwise(F.col("l")).alias("key"), F.lit(None).cast("string").alias("seq"), none.alias("coverage"), none.alias("l"), none.alias("r"))
            met = rows.unionByName(word)
            # keys are shuffled in PARTS shares, one after the other, so that only one share's shuffle lies on disk
            parts = [met.where(F.pmod("key", F.lit(PARTS)) == i).repartition("key").sortWithinPartitions("key").mapInArrow(_glue(k), PIECE) for i in range(PARTS)]
        before, path = path, None
        for part in parts:
            now, path = stage_by(part, "open", "unitig-pieces", path, **PACKED)
        delete(spark, f"{before}/open=true")
        done.append(now.where("NOT open"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    length = F.length("seq").cast("long")
    return out.select("seq", length.alias("length"), (length - (k - 1)).alias("n_nodes"), "coverage")
