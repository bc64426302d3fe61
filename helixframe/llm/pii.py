"""Operator 10, PII: patterns find identifiers, corpus statistics find the terms that give them away.

Base spans (email, ip, card, phone) follow the contract's patterns.  The method adds spans of kind secret:
runs of ``SECRET`` characters with letters and digits whose characters carry ``SECRET_BITS`` bits each or
more, as keys and tokens do and words don't.  Protected entities are classes, from the kind down: every
kind, the domain of an email, the first half of an address, the issuer's digits of a card, what precedes
the last seven digits of a phone number, and every single value.  Information-theoretic sanitisation:
with N documents, n(e) that mention entity e, n(t) that
hold term t and n(t, e) that hold t within ``window`` words of e, the term discloses
log(n(t, e) N / (n(t) n(e))) of the entity's log(N / n(e)) bits.  Terms with a share of at least
``generalise`` and ``min_docs`` common documents are generalised, from ``remove`` on removed, wherever
they occur.  Counts come from all documents.

Scale: pairs are counted in the tasks before they are shuffled; n(t) is counted for terms that pass
n(t, e) alone, and of those only for the ones that can still disclose enough: n(t) within one part of the
documents in ``PARTS`` is a lower bound of n(t), and a term that exceeds with that already what n(t, e)
allows is out.  The bound only saves counting; the counts that decide are of all documents.  Up to ``max_terms`` terms are sent to the tasks; beyond that terms meet the documents'
words by shuffled joins on the term's hash.

Terms of a whole kind give away that a secret is there, not which; terms of a narrow class or a value give
away more.  Either is generalised or removed by the same thresholds.

Edge cases: null text is empty and has no spans; candidates that fail a check (parts over 255, Luhn,
digits) are dropped without a second try; terms that touch a base span are none; repeated rows count
and are marked each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage

#: Fixed by the contract, in this order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match of the contract's pattern can't start inside a run of digits, so looking there is left out.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}")
SECRET_BITS = 3.0
#: One part of the documents in so many gives a lower bound of n(t); counts are handed on at HELD different keys.
PARTS, HELD = 16, 1 << 17
ADDED = ("secret", "term")
ORDER = {kind: i for i, kind in enumerate((*KINDS, *ADDED))}
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    at = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            at = m.end()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def looks_random(value: str) -> bool:
    """Letters and digits, at least four of each, at SECRET_BITS bits a character or more."""
    digits = sum(c.isdigit() for c in value)
    if digits < 4 or sum(c.isalpha() for c in value) < 4:
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= SECRET_BITS


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(secret, start, end) of what looks random and touches no base span."""
    found = [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if looks_random(m[0])]
    if not found or not base:
        return found
    covered = _union(base)
    return [x for x in found if not _touches(covered, x[1], x[2])]


def protected_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans and secrets, by start and then kind."""
    base = base_spans(text)
    more = secret_spans(text, base) if text else []
    return sorted(base + more, key=lambda x: (x[1], ORDER[x[0]], x[2])) if more else base


def entities(kind: str, value: str) -> list[int]:
    """The protected classes of a value, from its kind down to itself, as signed 64-bit hashes; never 0."""
    normal = NOT_DIGIT.sub("", value) if kind in ("card", "phone") else value if kind == "secret" else value.lower()
    part = {"email": normal.rpartition("@")[2], "ip": ".".join(normal.split(".")[:2]), "card": normal[:6], "phone": normal[:-7]}.get(kind)
    out = []
    for name in (kind, *([f"{kind}~{part}"] if part else []), f"{kind}:{normal}"):
        h = xxhash.xxh3_64_intdigest(name) | 1
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def term_hash(term: str) -> int:
    h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> dict[int, set[str]]:
    """Protected class -> lower-cased terms within window words of one of its mentions, outside all spans."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    covered = _union(spans)
    out: dict[int, set[str]] = {}
    first = 0
    for kind, s, e in spans:
        own = [out.setdefault(c, set()) for c in entities(kind, text[s:e])]
        while first < len(words) and words[first][1] <= s:
            first += 1
        last = first
        while last < len(words) and words[last][0] < e:
            last += 1
        lo, hi = max(0, first - window), min(len(words), last + window)
        if lo >= hi:
            continue
        left, right = words[lo][0], words[hi - 1][1]
        for m in TERM.finditer(text, left, right):
            if not _touches(covered, m.start(), m.end()):
                for terms in own:
                    terms.add(m[0].lower())
    return out


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans (by start) cover, as disjoint intervals."""
    out: list[tuple[int, int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _touches(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the disjoint intervals."""
    i = bisect.bisect_left(covered, (end,)) - 1
    return i >= 0 and covered[i][1] > start


def _counted(batches, count, schema: pa.Schema):
    """Counts of what count(text, counter) adds for each text, once a task or whenever HELD keys are held."""
    counts: Counter = Counter()

    def batch() -> pa.RecordBatch:
        keys = [k if isinstance(k, tuple) else (k,) for k in counts]
        columns = [*zip(*keys, strict=True), list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        for text in b.column("text").to_pylist():
            count(text, counts)
        if len(counts) >= HELD:
            yield batch()
            counts.clear()
    if counts:
        yield batch()


def _mentions(docs: DataFrame, window: int) -> DataFrame:
    """(e, t, n): documents with protected class e (t empty), or with term t near e; e = 0: all documents."""
    schema = pa.schema([("e", pa.int64()), ("t", pa.string()), ("n", pa.int64())])

    def count(text: str | None, counts: Counter) -> None:
        counts[0, ""] += 1
        if spans := protected_spans(text):
            for e, terms in near_terms(text, spans, window).items():
                counts[e, ""] += 1
                counts.update((e, t) for t in terms)

    return docs.select("text").mapInArrow(lambda batches: _counted(batches, count, schema), "e long, t string, n long").groupBy("e", "t").agg(F.sum("n").alias("n"))


def _term_counts(docs: DataFrame, only: frozenset[int] | None) -> DataFrame:
    """(th, nt): documents with each term, of the hashes in only if given."""
    schema = pa.schema([("th", pa.int64()), ("n", pa.int64())])

    def count(text: str | None, counts: Counter) -> None:
        hashes = {term_hash(t) for t in set(TERM.findall((text or "").lower()))}
        counts.update(hashes if only is None else hashes & only)

    return docs.select("text").mapInArrow(lambda batches: _counted(batches, count, schema), "th long, n long").groupBy("th").agg(F.sum("n").alias("nt"))


def _hashes(terms: DataFrame, max_terms: int) -> frozenset[int] | None:
    """Hashes of the terms(t) to look for; None if there are too many to hold."""
    few = terms.select("t").distinct().limit(max_terms + 1).collect()
    return frozenset(term_hash(r.t) for r in few) if len(few) <= max_terms else None


def disclosing_terms(docs: DataFrame, window: int = 8, min_docs: int = 3, generalise: float = 0.9, max_terms: int = 200_000) -> DataFrame:
    """(th, t, disclosure): terms that reveal at least one entity, with their largest share."""
    arrow_rows(docs.sparkSession)
    counts = stage(_mentions(docs, window), "pii-counts")
    total = counts.where("e = 0").select("n").first()
    entities = counts.where("e != 0 AND t = ''").select("e", F.col("n").alias("ne"))
    pairs = stage(counts.where((F.col("t") != "") & (F.col("n") >= min_docs)).join(entities, "e").select("t", "n", "ne"), "pii-pairs")
    hashed = pairs.withColumn("th", _hash_of(F.col("t")))
    if total is None or pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "th long, t string, disclosure double")
    most = F.col("n") * F.pow(F.lit(float(total.n)) / F.col("ne"), F.lit(1 - generalise)) * F.lit(1 + 1e-9)  # n(t) at the threshold
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == 0)
    likely = stage(hashed.join(_term_counts(part, _hashes(pairs, max_terms)), "th", "left").where(F.coalesce("nt", F.lit(0)) <= most).drop("nt"), "pii-likely")
    met = likely.join(_term_counts(docs, _hashes(likely, max_terms)), "th")
    share = F.log(F.col("n") * F.lit(float(total.n)) / (F.col("nt") * F.col("ne"))) / F.log(F.lit(float(total.n)) / F.col("ne"))
    return stage(met.where(F.col("ne") < total.n).withColumn("disclosure", share).groupBy("th", "t").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise), "pii-terms")


def _hash_of(col):
    @F.pandas_udf("long")
    def hashes(s):
        return s.map(term_hash)

    return hashes(col)


def find_pii(docs: DataFrame, window: int = 8, min_docs: int = 3, generalise: float = 0.9, remove: float = 0.97, max_terms: int = 200_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text, spans): spans of (kind, start, stop, action), by start and kind."""
    terms = disclosing_terms(docs, window, min_docs, generalise, max_terms)
    rows = terms.select("t", "disclosure").limit(max_terms + 1).collect()
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    if len(rows) <= max_terms:
        known = {r.t: r.disclosure for r in rows}
    else:
        known, plain = None, _with_terms(plain, terms)

    def run(batches):
        for b in batches:
            spans = []
            own = b.column("terms").to_pylist() if known is None else None
            for i, text in enumerate(b.column("text").to_pylist()):
                wanted = known if known is not None else {x["t"]: x["disclosure"] for x in own[i] or ()}
                spans.append([{"kind": k, "start": s, "stop": e, "action": a} for k, s, e, a in all_spans(text, wanted, remove)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("action", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return plain.mapInArrow(run, "doc_id long, text string, spans array<struct<kind:string,start:bigint,stop:bigint,action:string>>")


def _with_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(doc_id, text) with terms, those of its words that are in terms(th, t, disclosure)."""
    keyed = docs.withColumn("mark", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            rows = [(i, m, h) for i, m, t in zip(*(b.column(x).to_pylist() for x in ("doc_id", "mark", "text")), strict=True) for h in {term_hash(x) for x in set(TERM.findall((t or "").lower()))}]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "mark", "th"])

    met = keyed.mapInArrow(run, "doc_id long, mark long, th long").distinct().join(terms, "th")
    listed = met.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("t", "disclosure")).alias("terms"))
    return keyed.join(listed, keyed["doc_id"].eqNullSafe(F.col("of")) & (keyed["mark"] == F.col("of_mark")), "left").select("doc_id", "text", "terms")


def all_spans(text: str | None, terms: dict[str, float], remove: float) -> list[tuple[str, int, int, str]]:
    """Base spans and secrets (generalised to their kind) and occurrences of terms that touch none."""
    base = protected_spans(text)
    out = [(k, s, e, "generalise") for k, s, e in base]
    if terms and text:
        covered = _union(base)
        for m in TERM.finditer(text):
            share = terms.get(m[0].lower())
            if share is not None and not _touches(covered, m.start(), m.end()):
                out.append(("term", m.start(), m.end(), "remove" if share >= remove else "generalise"))
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """Text with its spans replaced: identifiers by their kind, terms by [TERM] or by nothing."""
    out, at = [], 0
    for kind, s, e, action in spans:
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], PLACEHOLDER.get(kind, "[TERM]" if action == "generalise" else "")]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text) without personal data and the terms that reveal it."""
    found = find_pii(docs, **options)

    def run(batches):
        for b in batches:
            texts = [None if t is None else sanitised(t, [(x["kind"], x["start"], x["stop"], x["action"]) for x in spans]) for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(run, "doc_id long, text string")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract of op10."""
    found = find_pii(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    more = [*map(count, ADDED), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
