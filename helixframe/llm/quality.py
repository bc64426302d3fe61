"""Operator 7, quality classifier: zstandard dictionaries of good and bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes and every block is compressed with either dictionary; the
difference of the two totals over the bytes of the text is the raw score (over the sum of the totals,
endless repeats, tiny under both, would score at random).  A logistic fit on labelled rows that took no
part in the dictionaries turns it into a probability; the compressed share of the text is its second
input, as a difference of zero means junk for endless repeats and nothing for a text of three words.

Fitting uses a bounded sample: of the labelled rows allowed for learning whose text has 1 to
``max_doc_bytes`` bytes, the ``per_class`` smallest by a hash of doc_id in each class.  Scoring reads
every whole text.

Edge cases: null and empty text get the calibrated score of difference zero and share one; labels with under two usable
rows of a class teach nothing, every score is then 0.5; rows with equal doc_id are scored each on its own text; other columns
pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, bucket, smallest_by_hash

BLOCK = 2048
LEVEL = 3
#: Fixed by zstandard: how a trained dictionary begins.
MAGIC = b"\x37\xa4\x30\xec"


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the difference, of the compressed share, offset; empty: nothing learned

    def scorer(self):
        """text -> probability that the label is 1."""
        if not self.weights:
            return lambda text: 0.5
        good, bad = (zstandard.ZstdCompressor(dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))

        def score(text: str | None) -> float:
            return _sigmoid(sum(w * x for w, x in zip(self.weights, (*_measures(text, good, bad), 1.0), strict=True)))

        return score


def _dictionary(d: bytes) -> zstandard.ZstdCompressionDict:
    trained = d[:4] == MAGIC
    out = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    out.precompute_compress(level=LEVEL)
    return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _measures(text: str | None, good, bad) -> tuple[float, float]:
    """Difference of the compressed sizes over the bytes of the text; compressed share, 1 at most."""
    data = (text or "").encode("utf-8", "surrogatepass")
    g = b = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return ((b - g) / len(data), min(1.0, g / len(data))) if data else (0.0, 1.0)


def _train(texts: list[str], size: int) -> bytes:
    blocks = [d[at : at + BLOCK] for d in (t.encode("utf-8", "surrogatepass") for t in texts) for at in range(0, len(d), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, blocks)) // 4)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(blocks)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights (the last is the offset) by Newton's method; columns are scaled to unit deviation inside."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w[:-1] / scale).tolist()) + (float(w[-1] - (w[:-1] * mean / scale).sum()),)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_doc_bytes: int = 32768, dictionary_bytes: int = 65536) -> QualityModel:
    """Learn from labels(doc_id, quality) outside fold 0 of 5; see the module's docstring."""
    allowed = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket() != 0))
    once = allowed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = smallest_by_hash(once, "quality", "doc_id", per_class)
    chosen = docs.sparkSession.createDataFrame([(key, q, n) for q, found in picked.items() for n, (_, key) in enumerate(found)], "chosen long, quality int, n int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text").between(1, max_doc_bytes))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).dropDuplicates(["doc_id"]).collect()  # at most 2 * per_class
    rows.sort(key=lambda r: r.n)
    of = {q: [r.text for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, of.values())) < 2:
        return QualityModel(b"", b"", ())
    parts = {q: (t[: len(t) * 2 // 3 or 1], t[len(t) * 2 // 3 or 1 :]) for q, t in of.items()}
    good, bad = _train(parts[1][0], dictionary_bytes), _train(parts[0][0], dictionary_bytes)
    compress = [zstandard.ZstdCompressor(dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]
    held = [(*_measures(t, *compress), q) for q in (0, 1) for t in parts[q][1]]
    table = np.array(held, dtype=float)
    return QualityModel(good, bad, _logistic(table[:, :2], table[:, 2]))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with a column score (double, 0 to 1)."""
    names = [x for x in docs.columns if x != "score"]

    def run(batches):
        score = model.scorer()
        for b in batches:
            scores = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(scores, pa.float64())], [*names, "score"])

    arrow_rows(docs.sparkSession)
    plain = docs.select(*names)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
