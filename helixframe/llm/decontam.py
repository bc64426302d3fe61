"""Operator 3, benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased.  An item of n words is looked for in windows of n
words (the whole text where that is shorter).  Of windows that share a shingle with an item of their
size - no other can have a similarity above zero - the 64-bit SimHash is taken from prefix sums of bit
votes.  The 64 bits are cut into ``PIECES`` blocks whose allowances add up to ``radius`` less one for each
block but the first: an item within ``radius`` bits stays within the allowance of one block at least, so
the union of the blocks' tables, which list the items near each value, misses none.  With radius 23 it
lets 36 in 100 unrelated fingerprints through (blocks that must agree exactly would let 99 through), the
distance itself 2 in 100.  What is left is decided by the exact weighted similarity: shared over united
shingle counts, at least ``similarity``.  At 0.8 a true pair is 10 bits apart on average with a deviation
of 3, so radius 23 loses one in two million.

Items are taken in blocks of at most ``block_items`` items or ``block_bytes`` bytes on average, one pass
over the texts for each; only a block is ever sent to the tasks.

Edge cases: null or wordless texts and items match nothing; an item of fewer than ``words`` words is one
shingle; equal items are reported each; of equally similar windows the first counts; repeated rows are
judged each; empty tables give empty results; other columns pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

WORD = re.compile(r"[^\W_]+")
#: Blocks of 16 bits of a fingerprint, and the cells of (window, item) tables that are looked at together.
PIECES, BITS = 4, 16
CELLS = 1 << 22
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(word_hashes) - k + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        h = _scramble(h * MIX[j % len(MIX)] + word_hashes[j : j + n] + np.uint64(j))
    return h


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in words), dtype=np.uint64, count=len(words))


def _prefix_votes(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def _window_fingerprints(votes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    ones = votes[starts + m] - votes[starts]
    return np.packbits(2 * ones > m, axis=1).view(">u8").astype(np.uint64).ravel()


class ItemIndex:
    """A block of items: word hashes, shingle table, and for each item length the multi-index tables."""

    def __init__(self, items: list[tuple[int, str]], words: int, similarity: float, radius: int):
        self.words, self.similarity, self.radius = words, similarity, radius
        self.ids, self.lengths, self.counts, prints = [], [], [], []
        self.vocabulary: dict[str, int] = {}
        of: dict[int, set[int]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            hashes = _hashes(w)
            self.vocabulary.update(zip(w, hashes.tolist(), strict=True))
            h = _shingles(hashes, min(words, len(w)))
            for s in h.tolist():
                of.setdefault(s, set()).add(len(self.ids))
            self.ids.append(item_id)
            self.lengths.append(len(w))
            self.counts.append(Counter(h.tolist()))
            prints.append(int(_window_fingerprints(_prefix_votes(h), np.array([0]), len(h))[0]))
        self.of = of
        self.prints = np.array(prints, dtype=np.uint64)
        self.sizes = sorted({min(words, n) for n in self.lengths})
        self.known = {k: np.array(sorted({s for n, c in zip(self.lengths, self.counts, strict=True) if min(words, n) == k for s in c}), dtype=np.uint64) for k in self.sizes}
        spare = radius - (PIECES - 1)
        self.allowed = [(spare + i) // PIECES for i in range(PIECES)]  # each may be -1: no item is that near
        self.by_length = {n: (own, self._tables(self.prints[own])) for n in set(self.lengths) for own in [np.array([i for i, x in enumerate(self.lengths) if x == n])]}

    def _tables(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each block, by its value: bits of the items that stay within the block's allowance."""
        values, out = np.arange(1 << BITS, dtype=np.uint16), []
        for piece, most in enumerate(self.allowed):
            table = np.zeros((1 << BITS, -(-len(prints) // 8)), dtype=np.uint8)
            for at in range(0, len(prints), 64):
                own = ((prints[at : at + 64] >> np.uint64(BITS * piece)) & np.uint64(0xFFFF)).astype(np.uint16)
                table[:, at // 8 : at // 8 + 8] = np.packbits(np.bitwise_count(values[:, None] ^ own[None, :]).astype(np.int8) <= most, axis=1)
            out.append(table)
        return out

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of fingerprints within radius of an item of n words."""
        own, tables = self.by_length[n]
        met = np.zeros((len(prints), tables[0].shape[1]), dtype=np.uint8)
        for piece, table in enumerate(tables):
            met |= table[(prints >> np.uint64(BITS * piece)) & np.uint64(0xFFFF)]
        at, i = np.nonzero(np.unpackbits(met, axis=1, count=len(own)))
        close = np.bitwise_count(prints[at] ^ self.prints[own[i]]) <= self.radius
        return at[close], own[i[close]]

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[float, int]]]:
        """For each text: item index -> (similarity, first word of its best window)."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        lists = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in lists], dtype=np.int64)
        get = self.vocabulary.get
        flat = np.fromiter((get(x, 0) for w in lists for x in w), dtype=np.uint64, count=int(lengths.sum()))
        ends = np.cumsum(lengths)
        for d in self._with_hits(flat, ends):
            self._search(lists[d], out[d])
        return out

    def _with_hits(self, flat: np.ndarray, ends: np.ndarray) -> list[int]:
        found: set[int] = set()
        known = flat != 0
        for k in self.sizes:
            if len(known) < k:
                continue
            run = known[: len(known) - k + 1].copy()
            for j in range(1, k):
                run &= known[j : len(known) - k + 1 + j]
            at = np.flatnonzero(run)
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                h = _scramble(h * MIX[j % len(MIX)] + flat[at + j] + np.uint64(j))
            at = at[np.isin(h, self.known[k])]
            doc = np.searchsorted(ends, at, side="right")
            found.update(doc[at + k <= ends[doc]].tolist() if len(at) else [])
        return sorted(found)

    def _search(self, words: list[str], best: dict[int, tuple[float, int]]) -> None:
        hashes = _hashes(words)
        for k in self.sizes:
            h = _shingles(hashes, k)
            hits = np.flatnonzero(np.isin(h, self.known[k]))
            lengths: dict[int, list[int]] = {}
            for p in hits.tolist():
                for n in {self.lengths[i] for i in self.of[int(h[p])] if min(self.words, self.lengths[i]) == k}:
                    lengths.setdefault(n, []).append(p)
            votes = _prefix_votes(h) if lengths else None
            for n, places in lengths.items():
                size = min(n, len(words))
                m = size - k + 1
                p = np.array(places)
                last = len(words) - size
                edges = np.zeros(last + 2, dtype=np.int32)
                np.add.at(edges, np.clip(p - m + 1, 0, last), 1)
                np.add.at(edges, np.minimum(p, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                prints = _window_fingerprints(votes, starts, m)
                many = max(64, CELLS // len(self.by_length[n][0]))
                for at in range(0, len(starts), many):
                    for w, i in zip(*self.near(prints[at : at + many], n), strict=True):
                        self._verify(h, int(starts[at + w]), m, int(i), best)

    def _verify(self, h: np.ndarray, start: int, m: int, item: int, best: dict[int, tuple[float, int]]) -> None:
        window, counts = Counter(h[start : start + m].tolist()), self.counts[item]
        shared = sum(min(c, counts[s]) for s, c in window.items() if s in counts)
        value = shared / (m + counts.total() - shared)
        if value >= self.similarity and (item not in best or value > best[item][0]):
            best[item] = value, start


def _blocks(benchmark: DataFrame, block_items: int, block_bytes: int):
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    count, size = items.agg(F.count("text"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // block_items), -(-size // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i)
        yield sorted((r.item_id, r.text) for r in part.collect() if r.item_id is not None)


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 23, block_items: int = 4_000, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): every benchmark item found in each document."""
    arrow_rows(docs.sparkSession)
    out, schema = None, "doc_id long, item_id long, similarity double, start_word long, n_words long"
    for items in _blocks(benchmark, block_items, block_bytes):

        def run(batches, items=items):
            index = ItemIndex(items, words, similarity, radius)
            for b in batches:
                rows = [(d, index.ids[i], s, at, index.lengths[i]) for d, found in zip(b.column("doc_id").to_pylist(), index.matches(b.column("text").to_pylist()), strict=True) for i, (s, at) in sorted(found.items())]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 23, block_items: int = 4_000, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows that hold a benchmark item; texts are not shuffled."""
    arrow_rows(docs.sparkSession)
    for items in _blocks(benchmark, block_items, block_bytes):

        def run(batches, items=items):
            index = ItemIndex(items, words, similarity, radius)
            for b in batches:
                yield b.filter(pa.array([not found for found in index.matches(b.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
