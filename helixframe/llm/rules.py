"""Operator 1, quality rules: weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  Votes of all documents are counted by pattern (at
most 3 ** len(RULES) rows, whatever the corpus' size); expectation-maximisation over the patterns
estimates how accurate each rule is and how common good documents are; a document's posterior
probability of being good replaces "all rules must pass".

Words are runs of anything but ``[\\x20\\x09-\\x0D]``.  Measures are taken in one pass, row by row, and
staged (a few numbers a document) because both the counts and the verdicts need them; texts are neither
shuffled nor handed to Python.

Edge cases: null text has no words and no lines; an empty table gives an empty result; repeated rows are
judged each and weigh each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SPACE = r"[\x20\x09-\x0D]+"

#: Rule name -> (SQL condition for a good vote, SQL condition for a bad vote, which goes first); whole numbers only.
#: A detector of junk says nothing of a text in which it finds none, else many silent detectors would outvote one;
#: each kind of junk has two detectors, as EM finds a lone voice that nothing supports to be in error.
PLAIN = "100 * n_symbols <= 2 * n_words AND 100 * n_capitals <= 15 * word_chars"
RULES: dict[str, tuple[str, str]] = {
    "length": ("FALSE", "n_words < 10"),
    "word_length": ("FALSE", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "symbols": ("FALSE", "100 * n_symbols > 10 * n_words"),
    "symbol_share": ("FALSE", "100 * n_symbols > 4 * word_chars"),
    "repeated_lines": ("FALSE", "10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("FALSE", "100 * n_repeat_words > 20 * n_words"),
    "capitals": ("FALSE", "100 * n_capitals > 40 * word_chars"),
    "stops": ("FALSE", "100 * n_stops > 40 * n_words"),
    "sentences": (f"n_words <= 40 * n_stops AND {PLAIN}", "n_words >= 50 AND n_words > 100 * n_stops"),
    "variety": (f"n_words >= 20 AND 100 * n_repeat_words <= 5 * n_words AND n_dup_lines = 0 AND {PLAIN}", "100 * n_repeat_words > 40 * n_words"),
}
ROUNDS = 25
#: Where EM starts: share of good documents and accuracy of every rule; and bounds that fix what "good" means.
START = (0.5, 0.8)
ACCURACY_BOUNDS, SHARE_BOUNDS = (0.55, 0.99), (0.05, 0.95)


def _with_repeats(df: DataFrame) -> DataFrame:
    """df(words, ...) with n_words and n_repeat_words: words in a three-word window found twice or more.

    A window's hash keeps its position in the low bits, as many as the text needs, so sorting plain
    numbers brings equal windows together; neighbours count once their words really are equal.  Only
    texts in which a hash repeats at all are sorted.
    """
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("hashes", F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(slice(words, 1, int(n_words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) END"))
    df = df.withColumn("repeats", F.expr("size(array_distinct(hashes)) < size(hashes)"))
    df = df.withColumn("low", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))
    df = df.withColumn("sorted", F.expr("CASE WHEN repeats THEN sort_array(transform(hashes, (h, i) -> (h & ~low) | i)) END"))
    same_window = " AND ".join(f"get(words, int(a & low) + {j}) = get(words, int(b & low) + {j})" for j in range(3))
    df = df.withColumn(
        "pairs",
        F.expr(f"""CASE WHEN repeats THEN filter(
            zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted) - 1),
                     (a, b) -> CASE WHEN (a & ~low) = (b & ~low) AND {same_window} THEN array(a & low, b & low) END),
            p -> p IS NOT NULL) END"""),
    )
    df = df.withColumn("n_repeat_words", F.expr("CASE WHEN repeats THEN size(array_distinct(flatten(transform(flatten(pairs), p -> array(p, p + 1, p + 2))))) ELSE 0 END").cast("long"))
    return df.drop("hashes", "repeats", "low", "sorted", "pairs", "words")


def measures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_stops."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blank = F.lit(SPACE)
    rows = rows.select(
        "doc_id",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.length(F.regexp_replace("text", blank, F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.length(F.regexp_replace("text", F.lit("[^A-Z]+"), F.lit(""))).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[.?!](?:[\x20\x09-\x0D]|\z)")).cast("long").alias("n_stops"),
    )
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    return _with_repeats(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stops")


def votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(name) for name, (good, bad) in RULES.items()]


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], x))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """(share of good documents, accuracy of each rule) by EM over (votes, count).

    An accuracy is the chance that a vote that is cast is right; abstaining says nothing.
    """
    share, accuracy = START[0], [START[1]] * len(RULES)
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        weighed = [(v, c, c * posterior(v, share, accuracy)) for v, c in patterns]
        for j in range(len(RULES)):
            right = sum(p if v[j] > 0 else c - p for v, c, p in weighed if v[j])
            accuracy[j] = _within((START[1] + right) / (1 + sum(c for v, c, _ in weighed if v[j])), ACCURACY_BOUNDS)
        share = _within(sum(p for _, _, p in weighed) / total, SHARE_BOUNDS)
    return share, accuracy


def posterior(v: tuple[int, ...], share: float, accuracy: list[float]) -> float:
    odds = math.log(share / (1 - share)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, accuracy, strict=True))
    return 1 / (1 + math.exp(-odds))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the measures, base_failed, posterior (6 decimals), kept."""
    found = stage(measures(docs).select("*", *votes()), "rule-votes")
    rows = found.groupBy(*RULES).count().collect()  # at most 3 ** len(RULES) rows
    patterns = sorted((tuple(r[x] for x in RULES), r["count"]) for r in rows)
    share, accuracy = estimate(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for name, a in zip(RULES, accuracy, strict=True):
        odds = odds + F.col(name) * F.lit(math.log(a / (1 - a)))
    base_failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return (
        found.withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), 6))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    )


def oracle() -> str:
    """DuckDB SQL for quality_rules: the same rounds of EM, unrolled."""
    names = list(RULES)
    vote = ",\n".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {name}" for name, (good, bad) in RULES.items())
    parts = [
        r"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
  len(regexp_extract_all(text, '[.?!](?:[\x20\x09-\x0D]|\z)'))::BIGINT AS n_stops
  FROM w LEFT JOIN rep USING (doc_id))""",
        f"v AS (SELECT *, {vote} FROM m)",
        f"pat AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS c FROM v GROUP BY ALL)",
        f"e0 AS (SELECT {START[0]}::DOUBLE AS share, " + ", ".join(f"{START[1]}::DOUBLE AS a_{x}" for x in names) + ")",
    ]
    odds = "ln(share / (1 - share))" + "".join(f" + {x} * ln(a_{x} / (1 - a_{x}))" for x in names)
    within = lambda x, bounds: f"least({bounds[1]}, greatest({bounds[0]}, {x}))"
    for k in range(1, ROUNDS + 1):
        right = lambda x: f"({START[1]} + sum(CASE WHEN {x} > 0 THEN p WHEN {x} < 0 THEN c - p ELSE 0 END)) / (1 + sum(c * abs({x})))"
        fitted = ", ".join(f"{within(right(x), ACCURACY_BOUNDS)} AS a_{x}" for x in names)
        parts.append(f"e{k} AS MATERIALIZED (SELECT {within('sum(p) / sum(c)', SHARE_BOUNDS)} AS share, {fitted} FROM (SELECT pat.*, c / (1 + exp(-({odds}))) AS p FROM pat, e{k - 1}))")
    parts.append(f"s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, round(1 / (1 + exp(-({odds}))), 6) AS posterior FROM v, e{ROUNDS})")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, posterior FROM s"
