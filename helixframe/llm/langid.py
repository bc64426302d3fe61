"""Operator 6, language identification with string kernels.

A text is the set of its byte n-grams (n = 1 to 3, lower-cased, hashed to ``DIMS``).  The blended
spectrum presence kernel of two texts is the number of n-grams they share over the geometric mean of
their numbers.  Nyström: with landmark texts Z, a text becomes k(text, Z) K(Z, Z)^(-1/2); one-versus-rest
kernel ridge regression is then ridge regression on these features with targets 1 and -1.

Scoring is a matrix product for each batch of texts.  k(text, Z) is itself a product of presence rows
and landmark columns, so both products are multiplied once when fitting and a text costs one row of
``DIMS`` by languages.  Every whole text is read.

Fitting uses a bounded sample: of rows with a language outside fold 2 of 4 and 1 to ``max_doc_bytes``
bytes, the ``per_lang`` smallest by a hash of doc_id in each language, ``max_rows`` in all (all languages
shrink alike).  Each gives its text and its first ``snippet`` characters, so that short texts are known.

Edge cases: null text, or text without a letter, is ``und`` with score 0; so is everything when no row
may be learned from; rows with equal doc_id are judged each on its own text; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, bucket, smallest_by_hash

DIMS = 1 << 15
BATCH = 128
LETTER = re.compile(r"[^\W\d_]")
SHARPNESS = 6.0


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the text, repeats included."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    mixed = [b, 0x10000 + two, 0x1000000 + three]
    return np.concatenate([(x * np.uint32(2654435761)) >> np.uint32(17) for x in mixed])


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text, 0 or 1 over the square root of the number of n-grams present."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, t in zip(out, texts, strict=True):
        row[grams(t)] = 1
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIMS by languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        for at in range(0, len(known), BATCH):
            part = known[at : at + BATCH]
            raw = presence([texts[i] for i in part]) @ self.weights
            e = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            share = e / e.sum(axis=1, keepdims=True)
            for i, best, s in zip(part, raw.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.languages[best], min(1.0, s)
        return names, scores


def fit(rows: list[tuple[str, str]], landmarks: int = 192, ridge: float = 1e-2) -> LanguageModel:
    """rows of (text, language), in an order that mixes languages; the first ones are the landmarks."""
    languages = tuple(sorted({lang for _, lang in rows}))
    if not rows:
        return LanguageModel((), np.zeros((DIMS, 0), dtype=np.float32))
    z = presence([t for t, _ in rows[:landmarks]])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    phi = np.concatenate([presence([t for t, _ in rows[at : at + BATCH]]) @ z.T for at in range(0, len(rows), BATCH)]).astype(np.float64) @ root
    own = np.array([languages.index(lang) for _, lang in rows])
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (len(rows) / len(languages) / np.bincount(own, minlength=len(languages)))[own][:, None]
    w = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]), phi.T @ (target * balance))
    return LanguageModel(languages, (z.T.astype(np.float64) @ (root @ w)).astype(np.float32))


def fit_languages(docs: DataFrame, per_lang: int = 400, max_rows: int = 3000, max_doc_bytes: int = 16384, snippet: int = 40) -> LanguageModel:
    """Learn from docs(doc_id, text, lang); see the module's docstring."""
    allowed = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (bucket(n=4) != 2) & F.octet_length("text").between(1, max_doc_bytes))
    allowed = allowed.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    picked = smallest_by_hash(allowed, "lang", "doc_id", per_lang)
    ids = sorted((n, lang, key) for lang, found in picked.items() for n, (_, key) in enumerate(found))[:max_rows]
    chosen = docs.sparkSession.createDataFrame(ids, "n int, of string, chosen long")
    rows = allowed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("of"))).dropDuplicates(["doc_id"]).collect()  # at most max_rows
    rows.sort(key=lambda r: (r.n, r.lang, r.doc_id))
    texts = [(r.text, r.lang) for r in rows if LETTER.search(r.text)]
    return fit(texts + [(t[:snippet], lang) for t, lang in texts if LETTER.search(t[:snippet])])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    plain = docs.drop("lang_pred", "score")
    names = plain.columns

    def run(batches):
        for b in batches:
            lang, score = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    arrow_rows(docs.sparkSession)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))
