"""Sequence functions as Columns (F1 to F15, T3, T5): built-ins only, so Catalyst keeps them in generated code.

Sequences are strings over A, C, G, T; complement pairs A-T and C-G; A < C < G < T.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(s: Column | str) -> Column:
    """C, G, T and U (read as T) in either case; anything else, a character outside ASCII too, is A."""
    return F.regexp_replace(F.translate(_c(s), "cgtuU", "CGTTT"), "[^CGT]", "A")


def project_text(s: Column | str) -> Column:
    """Letters a to z of a lower-cased text, mapped to A, C, G, T in turn; a stand-in for DNA."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(_c(s)), "[^a-z]", ""), letters, (BASES * 7)[:26])


def revcomp(s: Column | str) -> Column:
    """reverse complement."""
    return F.reverse(F.translate(_c(s), BASES, COMPLEMENT))


def canonical(s: Column | str) -> Column:
    """the smaller of a sequence and its reverse complement."""
    return F.least(_c(s), revcomp(s))


def is_palindrome(s: Column | str) -> Column:
    """equal to its reverse complement."""
    return _c(s) == revcomp(s)


def orientation(s: Column | str) -> Column:
    """1 forward, -1 reverse, 0 palindrome."""
    return F.when(_c(s) < revcomp(s), 1).when(_c(s) > revcomp(s), -1).otherwise(0)


def link_strength(a: Column | str, b: Column | str) -> Column:
    """(a - b) / max(a, b, 1)."""
    return (_c(a) - _c(b)).cast("double") / F.greatest(_c(a), _c(b), F.lit(1))


def link_strength_level(ls: Column | str, reference: float) -> Column:
    """how often |ls| must be squared to fall below reference, 127 at most."""
    step = lambda acc, _: F.when(acc["v"] < reference, acc).otherwise(F.struct((acc["v"] * acc["v"]).alias("v"), (acc["n"] + 1).alias("n")))
    start = F.struct(F.abs(_c(ls)).cast("double").alias("v"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(127)), start, step, lambda acc: acc["n"])


def universe_size(k: Column | str) -> Column:
    """number of canonical k-mers, k < 32."""
    k = _c(k).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), 2 * k - 1) + F.when(k % 2 == 0, F.call_function("shiftleft", F.lit(1).cast("long"), k - 1)).otherwise(F.lit(0))


def pair_id(x: Column | str, y: Column | str) -> Column:
    """F8: order-free triangular number of two ids."""
    low, high = F.least(_c(x), _c(y)), F.greatest(_c(x), _c(y))
    return F.floor(high * (high + 1) / 2) + low


def log2_floor(x: Column | str) -> Column:
    """floor of the binary logarithm, exact; x > 0."""
    return F.length(F.bin(_c(x))) - 1


def self_overlap(s: Column | str) -> Column:
    """length of the longest proper suffix that is a prefix; 0 without one."""
    s = _c(s)
    borders = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: (i < F.length(s)) & (F.left(s, i) == F.right(s, i)))
    return F.coalesce(F.array_max(borders), F.lit(0))


def edge_bit(direction: int, base: Column | str) -> Column:
    """bit of an edge mask: forward A to T 128 to 16, reverse 8 to 1."""
    return F.call_function("shiftright", F.lit(128 if direction == 0 else 8), F.instr(F.lit(BASES), _c(base)) - 1)


def edge_count(edges: Column | str) -> Column:
    """extensions in an edge mask."""
    return F.bit_count(_c(edges))


def is_ambiguous(edges: Column | str) -> Column:
    """T5 negated: more than one extension on a side."""
    e = _c(edges)
    return (F.bit_count(e.bitwiseAND(F.lit(240))) > 1) | (F.bit_count(e.bitwiseAND(F.lit(15))) > 1)


def coverage_quality(cov: Column | str) -> Column:
    """an array of coverages as a string of '!' to '~', the highest being '~'."""
    top = F.greatest(F.array_max(_c(cov)), F.lit(1))
    return F.array_join(F.transform(_c(cov), lambda c: F.chr((33 + F.floor(93 * c / top)).cast("int"))), "")


def percent(part: Column | str, rest: Column | str) -> Column:
    """100 part / (part + rest), null where there is neither."""
    whole = _c(part) + _c(rest)
    return F.when(whole > 0, 100 * _c(part) / whole)
