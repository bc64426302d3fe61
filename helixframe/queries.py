"""One query for each operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import seq as S
from .operators import cluster, compaction, kmers, links, maintain, reads, seeds, stats, visits
from .plans.staging import stage, staged_path
from .sources import fastx, graphs
from .streaming import counts as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- the same building blocks in SQL

LETTERS = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
DOCS = f"reads AS MATERIALIZED (SELECT doc_id AS read_id, {LETTERS} AS seq FROM documents)"
REFS = f"reads AS MATERIALIZED (SELECT item_id AS read_id, {LETTERS} AS seq FROM benchmark)"
PAIRS = f"""turns AS (SELECT conv_id, turn, {LETTERS} AS s1 FROM conversations),
pairs AS (SELECT conv_id * 1000 + turn AS pair_id, s1, lead(s1) OVER (PARTITION BY conv_id ORDER BY turn) AS s2 FROM turns QUALIFY s2 IS NOT NULL)"""
QREADS = """qreads AS (SELECT l_orderkey AS read_id, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_quantity, l_returnflag) AS seq,
string_agg(chr((33 + l_quantity)::INT), '' ORDER BY l_linenumber, l_quantity, l_returnflag) AS qual FROM lineitem GROUP BY 1)"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def canon(x: str) -> str:
    return f"least({x}, {rc(x)})"


def counts_sql(low: int, high: int, source: str = DOCS) -> str:
    return f"""{source}, pie AS (SELECT substr(seq, c * 256 + 1, {255 + high}) AS piece, least(256, length(seq) - c * 256) AS own FROM (SELECT seq, unnest(range(0, (length(seq) + 255) // 256)) AS c FROM reads)),
win AS (SELECT k, unnest(list_transform(range(1, least(own, length(piece) - k + 1) + 1), lambda p: substr(piece, p, k))) AS w
FROM pie, (SELECT unnest(range({low}, {high + 1})) AS k) WHERE length(piece) >= k),
cnt AS MATERIALIZED (SELECT k::BIGINT AS k, {canon('w')} AS kmer, sum(n)::BIGINT AS coverage FROM (SELECT k, w, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL)"""


def nodes_sql(low: int, high: int, source: str = DOCS) -> str:
    return f"""{counts_sql(low, high, source)},
ori AS MATERIALIZED (SELECT k, kmer, coverage, kmer AS w FROM cnt UNION ALL SELECT k, kmer, coverage, {rc('kmer')} FROM cnt WHERE kmer <> {rc('kmer')}),
pre AS (SELECT k - 1 AS k, left(w, k - 1) AS p, instr('ACGT', right(w, 1)) - 1 AS i FROM ori WHERE k > {low}),
msk AS (SELECT k, {canon('p')} AS kmer, bit_or(CASE WHEN p = {rc('p')} THEN (128 >> i) | (8 >> i) WHEN p < {rc('p')} THEN 128 >> i ELSE 8 >> i END) AS edges FROM pre GROUP BY ALL),
nod AS MATERIALIZED (SELECT cnt.k, cnt.kmer, coverage, coalesce(edges, 0)::INT AS edges, cnt.kmer = {rc('cnt.kmer')} AS is_palindrome FROM cnt LEFT JOIN msk USING (k, kmer))"""


PARENTS = f"""par AS MATERIALIZED (SELECT k, kmer, coverage, side, {canon('p')} AS parent, p > {rc('p')} AS reversed FROM
(SELECT k, kmer, coverage, 0 AS side, right(kmer, k - 1) AS p FROM nod UNION ALL SELECT k, kmer, coverage, 1, left(kmer, k - 1) FROM nod))"""
CHILDREN = f"""low AS (SELECT k - 1 AS k, left(w, k - 1) AS p, right(w, 1) AS base, kmer AS child, coverage AS child_coverage FROM ori),
chi AS MATERIALIZED (SELECT low.k, nod.kmer, dir, base, child, child_coverage FROM (
SELECT *, {canon('p')} AS kmer, unnest(CASE WHEN p = {rc('p')} THEN [0, 1] WHEN p < {rc('p')} THEN [0] ELSE [1] END) AS dir FROM low) low JOIN nod USING (k, kmer))"""


def cleaned_sql(min_k: int) -> str:
    return f"""{PARENTS}, tell AS (SELECT k + 1 AS k, kmer AS parent FROM nod WHERE is_palindrome OR bit_count(edges & 240) > 1 OR bit_count(edges & 15) > 1),
seed AS (SELECT DISTINCT k, kmer FROM par SEMI JOIN tell USING (k, parent) WHERE k > {min_k}),
sub AS (SELECT DISTINCT j AS k, {canon('substr(kmer, p, j)')} AS kmer FROM (SELECT kmer, j, unnest(range(1, k - j + 2)) AS p FROM (SELECT k, kmer, unnest(range({min_k + 1}, k + 1)) AS j FROM seed))),
keep AS MATERIALIZED (SELECT * FROM nod WHERE k <= {min_k} UNION ALL SELECT nod.* FROM nod SEMI JOIN sub USING (k, kmer) WHERE nod.k > {min_k})"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def doc_counts(spark: SparkSession, sf_dir: str, low: int = 2, high: int = 8) -> DataFrame:
    return kmers.count_kmers(X.reads(spark, sf_dir), low, high)


def ref_nodes(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    return stage(kmers.build_nodes(X.reference_reads(spark, sf_dir), low, high), "ref-nodes")


# ---- k-mers


@query(f"WITH {counts_sql(2, 8)} SELECT * FROM cnt")
def kmer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_counts(spark, sf_dir)


@query(f"WITH {counts_sql(11, 12)} SELECT k, coverage, count(*) AS n FROM cnt GROUP BY ALL")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_counts(spark, sf_dir, 11, 12).groupBy("k", "coverage").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {counts_sql(2, 6, "reads AS MATERIALIZED (SELECT doc_id AS read_id, regexp_replace(translate(text, 'cgtuU', 'CGTTT'), '[^CGT]', 'A', 'g') AS seq FROM documents)")} SELECT * FROM cnt")
def kmer_coverage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(X.raw_reads(spark, sf_dir), 2, 6)


@query(f"WITH {counts_sql(40, 41, REFS)} SELECT * FROM cnt")
def kmer_coverage_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(X.reference_reads(spark, sf_dir), 40, 41)


@query(f"WITH {REFS} SELECT read_id, k::BIGINT AS k, p - 1 AS pos, {canon('substr(seq, p, k)')} AS kmer FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS p FROM reads, (SELECT unnest([5, 9]) AS k) WHERE length(seq) >= k)")
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.windows(X.reference_reads(spark, sf_dir), [5, 9]).select("read_id", F.col("k").cast("long"), F.col("pos").cast("long"), "kmer")


@query(f"WITH {REFS} SELECT read_id, seq, {rc('seq')} AS revcomp, {canon('seq')} AS canonical, CASE WHEN seq < {rc('seq')} THEN 1 WHEN seq > {rc('seq')} THEN -1 ELSE 0 END AS orientation FROM reads")
def revcomp_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reference_reads(spark, sf_dir).select("read_id", "seq", S.revcomp("seq").alias("revcomp"), S.canonical("seq").alias("canonical"), S.orientation("seq").alias("orientation"))


@query(f"WITH {counts_sql(2, 8)} SELECT k, count(*) AS n, count(*) FILTER (kmer = {rc('kmer')}) AS palindromes FROM cnt GROUP BY k")
def palindrome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_counts(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_palindrome("kmer")).alias("palindromes"))


@query(f"WITH {REFS} SELECT read_id, coalesce(list_max(list_filter(range(1, length(seq)), lambda i: left(seq, i) = right(seq, i))), 0)::BIGINT AS overlap FROM reads")
def self_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reference_reads(spark, sf_dir).select("read_id", S.self_overlap("seq").cast("long").alias("overlap"))


@query(f"WITH {counts_sql(2, 8)} SELECT k, count(*) AS n, ((1::BIGINT << (2 * k - 1)::INT) + CASE WHEN k % 2 = 0 THEN 1::BIGINT << (k - 1)::INT ELSE 0 END)::BIGINT AS universe FROM cnt GROUP BY k")
def universe_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_counts(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", "n", S.universe_size("k").alias("universe"))


@query("""SELECT c_custkey, round((c_custkey - c_nationkey)::DOUBLE / greatest(c_custkey, c_nationkey, 1), 9) AS strength,
(greatest(c_custkey, c_nationkey) * (greatest(c_custkey, c_nationkey) + 1) // 2 + least(c_custkey, c_nationkey))::BIGINT AS pair,
(length(bin(c_custkey + 1)) - 1)::BIGINT AS log2, round(100.0 * c_custkey / (c_custkey + c_nationkey + 1), 6) AS percent FROM customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long")
    rows = X.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.round(S.link_strength(a, b), 9).alias("strength"), S.pair_id(a, b).alias("pair"), S.log2_floor(a + 1).cast("long").alias("log2"), F.round(S.percent(a, b + 1), 6).alias("percent"))


@query("""SELECT c_custkey, level FROM (SELECT c_custkey, (SELECT count(*) FROM range(0, 127) t(i) WHERE pow(v, pow(2, i)) >= 0.05) AS level
FROM (SELECT c_custkey, abs(c_custkey - c_nationkey)::DOUBLE / greatest(c_custkey, c_nationkey, 1) AS v FROM customer))""")
def link_strength_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "customer").select("c_custkey", S.link_strength_level(S.link_strength("c_custkey", "c_nationkey"), 0.05).cast("long").alias("level"))


# ---- reads


@query(f"WITH {QREADS} SELECT read_id, regexp_replace(seq, '^N+|N+$', '', 'g') AS seq FROM qreads")
def trim_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.trim(X.quality_reads(spark, sf_dir).select("read_id", "seq"))


@query(f"""WITH {QREADS}, k AS (SELECT *, list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) <> 'N' AND ascii(substr(qual, i, 1)) > 45) AS ok FROM qreads)
SELECT read_id, CASE WHEN len(ok) = 0 THEN '' ELSE substr(seq, list_min(ok), list_max(ok) - list_min(ok) + 1) END AS seq,
CASE WHEN len(ok) = 0 THEN '' ELSE substr(qual, list_min(ok), list_max(ok) - list_min(ok) + 1) END AS qual FROM k""")
def trim_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.trim(X.quality_reads(spark, sf_dir), quality="-")


@query(f"""WITH {QREADS}, p AS (SELECT read_id, seq AS raw, regexp_replace(seq, '^N+|N+$', '', 'g') AS seq FROM qreads)
SELECT length(seq) >= length(raw) // 2 AS kept, count(*) AS n, sum(length(seq))::BIGINT AS bases FROM p, range(0, 2) GROUP BY 1""")
def trim_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.quality_reads(spark, sf_dir).select(F.col("read_id").alias("pair_id"), F.col("seq").alias("s1"), F.col("seq").alias("s2"))
    return reads.route_pairs(pairs).groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


@query(f"WITH {DOCS} SELECT count(*) FILTER (length(seq) > 200) AS n_kept, count(*) FILTER (length(seq) <= 200) AS n_discarded FROM reads")
def discarded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.discarded_reads(X.reads(spark, sf_dir), 200)


@query(f"WITH {PAIRS} SELECT min(pair_id) AS pair_id, least(s1, s2) AS s1, greatest(s1, s2) AS s2, count(*) AS dupecount FROM pairs GROUP BY 2, 3")
def pair_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.unique_pairs(X.turn_pairs(spark, sf_dir))


@query(f"""WITH {QREADS}, c AS (SELECT read_id, seq, i, ascii(substr(qual, i, 1)) - 33 AS q FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM qreads)),
s AS (SELECT seq, i, sum(q) AS q, min(read_id) AS read_id, count(*) AS n FROM c GROUP BY ALL)
SELECT min(read_id) AS read_id, seq, string_agg(chr(least(126, q + 33)::INT), '' ORDER BY i) AS qual, max(n) AS dupecount FROM s GROUP BY seq""")
def pair_quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.joined_quality(X.quality_reads(spark, sf_dir))


# ---- graph


@query(f"WITH {nodes_sql(4, 10, REFS)} SELECT * FROM nod")
def edge_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.build_nodes(X.reference_reads(spark, sf_dir), 4, 10)


@query(f"WITH {nodes_sql(6, 8)} SELECT * FROM nod")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.build_nodes(X.reads(spark, sf_dir), 6, 8)


@query(f"WITH {nodes_sql(4, 10, REFS)} SELECT k, bit_count(edges)::BIGINT AS extensions, bit_count(edges & 240) > 1 OR bit_count(edges & 15) > 1 AS ambiguous, count(*) AS n FROM nod GROUP BY ALL")
def ambiguous_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = kmers.build_nodes(X.reference_reads(spark, sf_dir), 4, 10)
    return nodes.groupBy("k", S.edge_count("edges").cast("long").alias("extensions"), S.is_ambiguous("edges").alias("ambiguous")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {nodes_sql(4, 10, REFS)}, {PARENTS} SELECT par.k, par.kmer, side, parent, reversed, par.coverage, nod.coverage AS parent_coverage FROM par JOIN nod ON nod.k = par.k - 1 AND nod.kmer = parent")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.parents(ref_nodes(spark, sf_dir, 4, 10))


@query(f"WITH {nodes_sql(4, 10, REFS)}, {CHILDREN} SELECT k, kmer, dir, base, child, child_coverage FROM chi")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.children(ref_nodes(spark, sf_dir, 4, 10))


@query(f"""WITH {nodes_sql(6, 8, REFS)} SELECT a.k, a.kmer, a.w, right(b.w, 1) AS base, b.kmer AS neighbour, b.coverage AS neighbour_coverage
FROM ori a JOIN ori b ON a.k = b.k AND right(a.w, a.k - 1) = left(b.w, b.k - 1)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.neighbours(ref_nodes(spark, sf_dir, 6, 8))


@query(f"""WITH {nodes_sql(4, 8, REFS)}, spots AS (SELECT w, base, w || base AS whole FROM ori, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE k = 8),
suf AS (SELECT *, {canon('right(whole, j)')} AS kmer FROM (SELECT *, unnest(range(2, length(whole) + 1)) AS j FROM spots))
SELECT w, base, max(nod.k) AS k, arg_max(nod.kmer, nod.k) AS kmer FROM suf JOIN nod ON nod.k = suf.j AND nod.kmer = suf.kmer GROUP BY ALL""")
def advance_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    at = kmers.oriented(nodes.where("k = 8")).select("w", F.explode(F.array(*map(F.lit, S.BASES))).alias("base"))
    return links.advance(nodes, at)


@query(f"""WITH {counts_sql(4, 8)}, asked AS (SELECT DISTINCT translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM
(SELECT unnest(string_split(lower(text), ' ')) AS x FROM benchmark) WHERE regexp_full_match(x, '[a-z]{{4,8}}'))
SELECT seq, length(seq)::BIGINT AS k, {canon('seq')} AS kmer, coverage FROM asked LEFT JOIN cnt ON cnt.k = length(seq) AND cnt.kmer = {canon('seq')}""")
def find_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("x")).where(F.col("x").rlike("^[a-z]{4,8}$"))
    return links.find(doc_counts(spark, sf_dir, 4, 8), words.select(S.project_text("x").alias("seq")))


@query(f"WITH {nodes_sql(4, 8, REFS)}, {PARENTS} SELECT * FROM nod WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.k = nod.k + 1 AND parent = nod.kmer)")
def surface_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.surface(ref_nodes(spark, sf_dir, 4, 8))


@query(f"""WITH {nodes_sql(4, 10, REFS)}, {PARENTS}, {CHILDREN}, many AS (SELECT *, count(*) OVER (PARTITION BY k, kmer, dir) AS n FROM (SELECT DISTINCT k, kmer, dir, child FROM chi))
SELECT * FROM nod WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.k = nod.k + 1 AND parent = nod.kmer) AND NOT EXISTS (SELECT 1 FROM many WHERE n > 1 AND many.k = nod.k - 1 AND child = nod.kmer)""")
def redundant_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.redundant(ref_nodes(spark, sf_dir, 4, 10))


@query(f"""WITH {nodes_sql(4, 10, REFS)}, {CHILDREN}, near AS (SELECT chi.k, chi.kmer, dir FROM chi JOIN nod USING (k, kmer) WHERE pow((coverage - child_coverage)::DOUBLE / greatest(coverage, child_coverage, 1), 2) < 0.0025
GROUP BY ALL HAVING count(*) > 1) SELECT * FROM nod WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.k = nod.k AND near.kmer = nod.kmer)""")
def coverage_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.coverage_unambiguous(ref_nodes(spark, sf_dir, 4, 10), 0.0025)


@query(f"WITH {nodes_sql(5, 12, REFS)}, {cleaned_sql(6)} SELECT * FROM keep")
def clean_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.clean(ref_nodes(spark, sf_dir, 5, 12), 6)


@query(f"WITH {nodes_sql(5, 12, REFS)}, {cleaned_sql(6)} SELECT nod.k, count(*) AS nodes, count(keep.kmer) AS kept, count(*) - count(keep.kmer) AS removed FROM nod LEFT JOIN keep USING (k, kmer) GROUP BY nod.k")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 5, 12)
    kept = maintain.clean(nodes, 6).select("k", "kmer", F.lit(1).alias("stays"))
    return nodes.join(kept, ["k", "kmer"], "left").groupBy("k").agg(F.count(F.lit(1)).alias("nodes"), F.count("stays").alias("kept")).withColumn("removed", F.col("nodes") - F.col("kept"))


@query(f"""WITH {nodes_sql(5, 12, REFS)}, {cleaned_sql(6)}, gone AS (SELECT k, kmer, coverage, {canon('right(kmer, k - 1)')} AS suffix_parent, {canon('left(kmer, k - 1)')} AS prefix_parent FROM nod ANTI JOIN keep USING (k, kmer))
SELECT gone.* FROM gone WHERE EXISTS (SELECT 1 FROM keep WHERE keep.k = gone.k - 1 AND keep.kmer = suffix_parent) AND EXISTS (SELECT 1 FROM keep WHERE keep.k = gone.k - 1 AND keep.kmer = prefix_parent)""")
def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 5, 12)
    return links.shared_links(nodes, maintain.clean(nodes, 6))


def subtracted_sql(top: int, low: int, asked: str) -> str:
    """Levels from top to low; asked gives (kmer, amount) of the top one."""
    parts = []
    for k in range(top, low - 1, -1):
        if k == top:
            parts += [f"a{k} AS ({asked})", f"low{k} AS (SELECT kmer, 0 AS low FROM nod WHERE k = {k})"]
        else:
            up = f"s{k + 1}"
            parts.append(f"a{k} AS (SELECT kmer, sum(amount) AS amount FROM (SELECT {canon(f'right(kmer, {k})')} AS kmer, coverage - rest AS amount FROM {up} WHERE rest < coverage UNION ALL SELECT {canon(f'left(kmer, {k})')}, coverage - rest FROM {up} WHERE rest < coverage) GROUP BY 1)")
            parts.append(f"low{k} AS (SELECT {canon('p')} AS kmer, max(s) AS low FROM (SELECT left(w, {k}) AS p, sum(rest) AS s FROM (SELECT kmer AS w, rest FROM {up} UNION ALL SELECT {rc('kmer')}, rest FROM {up} WHERE kmer <> {rc('kmer')}) GROUP BY 1) GROUP BY 1)")
        parts.append(f"s{k} AS MATERIALIZED (SELECT k, kmer, coverage, greatest(coverage - coalesce(amount, 0), least(coalesce(low, 0), coverage), 0)::BIGINT AS rest FROM nod LEFT JOIN a{k} USING (kmer) LEFT JOIN low{k} USING (kmer) WHERE nod.k = {k})")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT k, kmer, rest AS coverage FROM s{k}" for k in range(top, low - 1, -1))


@query(f"WITH {nodes_sql(4, 8, REFS)}, {subtracted_sql(8, 4, 'SELECT kmer, 1 AS amount FROM nod WHERE k = 8 AND coverage > 1')}")
def subtract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return maintain.subtract_coverage(nodes, nodes.where("k = 8 AND coverage > 1").select("k", "kmer", F.lit(1).alias("amount")), 3)


@query(f"WITH {nodes_sql(4, 8, REFS)} SELECT k, kmer, 2::BIGINT AS amount, CASE WHEN is_palindrome THEN 'palindrome' ELSE 'coverage' END AS reason FROM nod WHERE k = 8 AND (is_palindrome OR coverage < 2)")
def subtract_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return maintain.refused_amounts(nodes, nodes.where("k = 8").select("k", "kmer", F.lit(2).cast("long").alias("amount")))


@query(f"WITH {nodes_sql(4, 8, REFS)}, {subtracted_sql(8, 4, 'SELECT kmer, 2 AS amount FROM nod WHERE k = 8 AND NOT is_palindrome AND coverage >= 2')}")
def subtract_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return maintain.subtract_coverage(nodes, nodes.where("k = 8").select("k", "kmer", F.lit(2).alias("amount")), 3, refuse=True)


@query(f"""WITH {nodes_sql(4, 8, REFS)}, sub AS (SELECT DISTINCT j AS k, {canon('substr(kmer, p, j)')} AS kmer FROM (SELECT kmer, j, unnest(range(1, k - j + 2)) AS p FROM (SELECT k, kmer, unnest(range(4, k + 1)) AS j FROM nod WHERE is_palindrome)))
SELECT nod.k, nod.kmer, coverage FROM nod SEMI JOIN sub USING (k, kmer)""")
def deep_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return maintain.deep_mark(nodes, nodes.where("is_palindrome"), 4).select("k", "kmer", "coverage")


@query(f"""WITH RECURSIVE {nodes_sql(4, 8, REFS)}, {PARENTS}, met(k, kmer) AS (SELECT k, kmer FROM nod WHERE k = 8 UNION SELECT up.k, up.kmer FROM met JOIN par ON par.k = met.k AND par.kmer = met.kmer JOIN nod up ON up.k = par.k - 1 AND up.kmer = parent
WHERE met.k > 2 AND pow((up.coverage - par.coverage)::DOUBLE / greatest(up.coverage, par.coverage, 1), 2) < 0.01) SELECT k, kmer, coverage FROM nod SEMI JOIN met USING (k, kmer)""")
def deep_marked_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return maintain.deep_mark_close(nodes, nodes.where("k = 8"), 0.01).select("k", "kmer", "coverage")


# ---- statistics


ROOTS = "(SELECT coverage FROM cnt UNION ALL SELECT 0 FROM range(0, 2))"


@query(f"WITH {counts_sql(2, 8)} SELECT coverage, count(*) AS n FROM {ROOTS} GROUP BY 1")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage_histogram(doc_counts(spark, sf_dir))


@query(f"WITH {counts_sql(2, 8)} SELECT count(*) AS n, sum(coverage)::BIGINT AS total, max(coverage) AS highest, (sum(coverage) // count(*))::BIGINT AS average FROM {ROOTS}")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage_totals(doc_counts(spark, sf_dir))


LOGS = "bins AS (SELECT k, (length(bin(coverage)) - 1)::BIGINT AS bin, count(*) AS n, sum(coverage)::BIGINT AS total, max(coverage) AS highest FROM cnt GROUP BY ALL)"


@query(f"WITH {counts_sql(2, 8)}, {LOGS} SELECT * FROM bins")
def log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_statistics(doc_counts(spark, sf_dir))


@query(f"WITH {counts_sql(2, 8)} SELECT coalesce(k, 0) AS k, count(*) AS n, sum(coverage)::BIGINT AS total, max(coverage) AS highest, (sum(coverage) // count(*))::BIGINT AS average FROM cnt GROUP BY ROLLUP (cnt.k)")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_totals(doc_counts(spark, sf_dir))


@query(f"""WITH {counts_sql(2, 8)}, {LOGS} SELECT k, coalesce((SELECT bin FROM bins b WHERE b.k = a.k AND bin >= 1 ORDER BY (length(bin(n)) - 1) * bin DESC, bin LIMIT 1), 0)::BIGINT AS hook FROM (SELECT DISTINCT k FROM bins) a""")
def log_mass_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_mass_hook(doc_counts(spark, sf_dir))


#: In SQL the pairs come from the reads, window by window.
ADJACENT = f"""seen AS (SELECT read_id, k, p, {canon('substr(seq, p, k)')} AS kmer FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS p FROM reads, (SELECT unnest(range(6, 10)) AS k) WHERE length(seq) > k)),
cov AS (SELECT read_id, seen.k, p, coverage AS a, lead(coverage) OVER (PARTITION BY read_id, seen.k ORDER BY p) AS b FROM seen JOIN cnt ON cnt.k = seen.k AND cnt.kmer = seen.kmer),
adj AS (SELECT k::BIGINT AS k, a, b FROM cov WHERE b IS NOT NULL)"""


@query(f"""WITH {counts_sql(6, 10, REFS)}, {ADJACENT}, d AS (SELECT k, abs(a - b)::DOUBLE / greatest(a, b) AS d FROM adj WHERE 10 * abs(a - b) < 9 * greatest(a, b))
SELECT k, count(*) AS n, round(sum(d) / count(*), 6) AS mean, round((sum(d * d) - sum(d) * sum(d) / count(*)) / count(*), 6) AS variance, round(sum(d * d) / count(*), 6) AS zero_variance FROM d GROUP BY k""")
def read_link_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_link_statistics(stage(kmers.count_kmers(X.reference_reads(spark, sf_dir), 6, 10), "counts"))


@query(f"WITH {counts_sql(6, 10, REFS)}, {ADJACENT} SELECT k, ((1000 * abs(a - b)) // greatest(a, b))::BIGINT AS bin, count(*) AS n FROM adj GROUP BY ALL")
def read_link_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_link_histogram(stage(kmers.count_kmers(X.reference_reads(spark, sf_dir), 6, 10), "counts"))


PER_NODE = "per AS (SELECT nod.k, nod.kmer, count(child) AS n_children FROM nod LEFT JOIN chi ON chi.k = nod.k AND chi.kmer = nod.kmer GROUP BY ALL)"


@query(f"WITH {nodes_sql(4, 10, REFS)}, {CHILDREN}, {PER_NODE} SELECT k, n_children, count(*) AS n FROM per GROUP BY ALL")
def child_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.child_statistics(ref_nodes(spark, sf_dir, 4, 10))


@query(f"WITH {nodes_sql(4, 10, REFS)}, {CHILDREN}, {PER_NODE} SELECT k, round(sum(n_children) / count(*), 6) AS average, round(count(*) FILTER (n_children <= 2) / count(*), 6) AS share_up_to_2 FROM per GROUP BY k")
def child_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.child_summary(ref_nodes(spark, sf_dir, 4, 10))


REF_MARKS = f"""refs AS (SELECT item_id AS ref_id, {LETTERS} AS seq FROM benchmark),
marks AS (SELECT DISTINCT ref_id, k::BIGINT AS k, {canon('substr(seq, p, k)')} AS kmer FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS p FROM refs, (SELECT unnest(range(6, 9)) AS k) WHERE length(seq) >= k))"""


@query(f"""WITH {counts_sql(6, 8)}, {REF_MARKS}, a AS (SELECT ref_id, marks.k, count(*) AS n, sum(coverage)::BIGINT AS m FROM marks JOIN cnt USING (k, kmer) GROUP BY ALL),
t AS (SELECT k, count(*) AS n, sum(coverage)::BIGINT AS m FROM cnt GROUP BY k),
r AS (SELECT g.ref_id, t.k, coalesce(a.n, 0) AS nodes_agree, t.n - coalesce(a.n, 0) AS nodes_disagree, coalesce(a.m, 0) AS mass_agree, t.m - coalesce(a.m, 0) AS mass_disagree
FROM (SELECT DISTINCT ref_id FROM refs) g CROSS JOIN t LEFT JOIN a ON a.ref_id = g.ref_id AND a.k = t.k)
SELECT *, round(100 * nodes_agree / (nodes_agree + nodes_disagree), 6) AS nodes_percent, round(100 * mass_agree / (mass_agree + mass_disagree), 6) AS mass_percent FROM r""")
def refcompare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_comparison(stage(doc_counts(spark, sf_dir, 6, 8), "counts"), X.references(spark, sf_dir), [6, 7, 8])


@query(f"WITH {counts_sql(6, 8)}, {REF_MARKS} SELECT k, kmer, coverage FROM cnt ANTI JOIN marks USING (k, kmer)")
def refcompare_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_agreement(doc_counts(spark, sf_dir, 6, 8), X.references(spark, sf_dir), [6, 7, 8], agree=False)


# ---- clusters and contigs (benchmark as reads, k from 9 to 11, pruned above 9)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(maintain.clean(ref_nodes(spark, sf_dir, 9, 11), 9), "pruned")


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _graph(spark, sf_dir)
    return nodes, stage(cluster.settled_groups(cluster.clusters(nodes, 9), 9), "groups")


ADJACENCY = f"""ids AS MATERIALIZED (SELECT *, lpad(k::VARCHAR, 3, '0') || ':' || kmer AS id FROM keep),
o2 AS (SELECT k, coverage, id, kmer AS w FROM ids UNION ALL SELECT k, coverage, id, {rc('kmer')} FROM ids WHERE kmer <> {rc('kmer')}),
ln AS (SELECT a.id AS x, b.id AS y, a.coverage AS p, b.coverage AS q FROM ids a, (SELECT unnest([0, 1]) AS side) s, ids b
  WHERE b.k = a.k - 1 AND b.kmer = CASE WHEN side = 0 THEN {canon('right(a.kmer, a.k - 1)')} ELSE {canon('left(a.kmer, a.k - 1)')} END
  UNION ALL SELECT a.id, b.id, a.coverage, b.coverage FROM o2 a JOIN o2 b ON a.k = b.k AND right(a.w, a.k - 1) = left(b.w, b.k - 1) WHERE a.id <> b.id),
adj AS MATERIALIZED (SELECT least(x, y) AS src, greatest(x, y) AS dst, min(abs(p - q)::DOUBLE / greatest(p, q, 1)) AS strength FROM ln GROUP BY 1, 2)"""


@query(f"WITH {nodes_sql(9, 11, REFS)}, {cleaned_sql(9)}, {ADJACENCY} SELECT src, dst, round(strength, 9) AS strength FROM adj")
def node_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.adjacency(_graph(spark, sf_dir), 9).select("src", "dst", F.round("strength", 9).alias("strength"))


GROUPED = f"""{nodes_sql(9, 11, REFS)}, {cleaned_sql(9)}, {ADJACENCY}, heads AS (SELECT k AS top, kmer AS head, id FROM ids WHERE is_palindrome),
own AS (SELECT id, (arg_min(head_id, [-top, 0]))::VARCHAR AS pal FROM (SELECT lpad(j::VARCHAR, 3, '0') || ':' || {canon('substr(head, p, j)')} AS id, top, lpad(top::VARCHAR, 3, '0') || ':' || head AS head_id
  FROM (SELECT *, unnest(range(1, top - j + 2)) AS p FROM (SELECT *, unnest(range(9, top + 1)) AS j FROM heads))) GROUP BY id),
free AS (SELECT id FROM ids WHERE id NOT IN (SELECT id FROM own)),
near AS MATERIALIZED (SELECT src, dst, strength FROM adj WHERE strength <= 0.05 AND src IN (FROM free) AND dst IN (FROM free)),
sym AS MATERIALIZED (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM free UNION
  SELECT s.dst, min(cc.comp) FROM cc JOIN sym s ON s.src = cc.id JOIN recurring.cc AS r ON r.id = s.dst WHERE cc.comp < r.comp GROUP BY s.dst),
clu AS MATERIALIZED (SELECT ids.id, ids.k, ids.kmer, ids.coverage, coalesce(own.pal, cc.comp) AS group_id, own.pal IS NOT NULL AS has_palindrome FROM ids LEFT JOIN own USING (id) LEFT JOIN cc USING (id))"""


@query(f"WITH RECURSIVE {GROUPED} SELECT k, kmer, coverage, group_id, has_palindrome FROM clu")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(_graph(spark, sf_dir), 9).select("k", "kmer", "coverage", "group_id", "has_palindrome")


@query(f"""WITH RECURSIVE {GROUPED}, ties AS (SELECT cc.comp AS group_id, max(near.strength) AS strength FROM near JOIN cc ON cc.id = near.src GROUP BY 1)
SELECT group_id, count(*) AS num_nodes, sum(coverage)::BIGINT AS mass, round(coalesce(max(ties.strength), 0), 9) AS strength, first(kmer ORDER BY k DESC, kmer) AS endpoint FROM clu LEFT JOIN ties USING (group_id) GROUP BY group_id""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_stats(cluster.clusters(_graph(spark, sf_dir), 9)).withColumn("strength", F.round("strength", 9))


@query(f"""WITH RECURSIVE {GROUPED} SELECT least(x.group_id, y.group_id) AS g1, greatest(x.group_id, y.group_id) AS g2, round(min(adj.strength), 9) AS link_strength
FROM adj JOIN clu x ON x.id = adj.src JOIN clu y ON y.id = adj.dst WHERE x.group_id <> y.group_id GROUP BY 1, 2""")
def cluster_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)
    return cluster.cluster_adjacency(nodes, stage(cluster.clusters(nodes, 9), "clusters"), 9).withColumn("link_strength", F.round("link_strength", 9))


@query()
def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.contigs(_groups(spark, sf_dir)[1], 9)


@query()
def merged_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, groups = _groups(spark, sf_dir)
    return cluster.contigs(cluster.merge_groups(nodes, groups, 9), 9)


@query(f"""WITH RECURSIVE {nodes_sql(15, 16, REFS)}, lv AS (SELECT * FROM nod WHERE k = 15),
st AS MATERIALIZED (SELECT kmer, kmer AS w, edges >> 4 AS ahead, edges & 15 AS back, is_palindrome FROM lv UNION ALL SELECT kmer, {rc('kmer')}, edges & 15, edges >> 4, is_palindrome FROM lv WHERE NOT is_palindrome),
lk AS MATERIALIZED (SELECT a.w AS wa, b.w AS wb, b.kmer AS next FROM st a JOIN st b ON right(a.w, 14) = left(b.w, 14) WHERE bit_count(a.ahead) = 1 AND bit_count(b.back) = 1 AND NOT a.is_palindrome AND NOT b.is_palindrome
  AND a.ahead = (8 >> (instr('ACGT', right(b.w, 1)) - 1)::INT) AND a.kmer <> b.kmer),
line(s, w, seq, seen) AS (SELECT w, w, w, [kmer] FROM st WHERE w NOT IN (SELECT wb FROM lk) UNION ALL SELECT s, wb, seq || right(wb, 1), list_append(seen, next) FROM line JOIN lk ON wa = w WHERE NOT list_contains(seen, next)),
lines AS MATERIALIZED (SELECT s, arg_max(seq, len(seen)) AS seq, arg_max(seen, len(seen)) AS seen FROM line GROUP BY s),
ring(s, w, seq, seen) AS (SELECT kmer, kmer, kmer, [kmer] FROM lv WHERE kmer NOT IN (SELECT unnest(seen) FROM lines) UNION ALL SELECT s, wb, seq || right(wb, 1), list_append(seen, next) FROM ring JOIN lk ON wa = w WHERE NOT list_contains(seen, next)),
rings AS (SELECT * FROM (SELECT s, arg_max(seq, len(seen)) AS seq, arg_max(seen, len(seen)) AS seen FROM ring GROUP BY s) WHERE s = list_min(seen)),
every AS (SELECT DISTINCT {canon('seq')} AS seq, list_sort(seen) AS seen FROM (SELECT seq, seen FROM lines UNION ALL SELECT seq, seen FROM rings))
SELECT seq, length(seq) AS length, len(seen)::BIGINT AS n_nodes, (SELECT sum(coverage)::BIGINT FROM lv WHERE list_contains(seen, lv.kmer)) AS coverage FROM every""")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.unitigs(ref_nodes(spark, sf_dir, 15, 16), 15)


@query()
def document_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.unitigs(X.reads(spark, sf_dir), 15)


@query()
def maxcov_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 9, 12)
    return cluster.max_coverage_contigs(nodes, nodes.where("k = 12").select(F.col("kmer").alias("seq")), 9)


@query(f"""WITH RECURSIVE {nodes_sql(9, 11, REFS)}, {cleaned_sql(9)}, {ADJACENCY},
sym AS MATERIALIZED (SELECT src, dst FROM adj WHERE strength <= 0.05 UNION SELECT dst, src FROM adj WHERE strength <= 0.05),
met(node) AS (SELECT * FROM (SELECT id FROM ids ORDER BY k, kmer LIMIT 1) UNION SELECT dst FROM met JOIN sym ON src = node) SELECT node FROM met""")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)
    start = nodes.orderBy("k", "kmer").limit(1).select(cluster.node_id().alias("node"))
    return cluster.reach(cluster.adjacency(nodes, 9).where("strength <= 0.05"), start)


@query(f"""WITH {nodes_sql(4, 8, REFS)}, {PARENTS}, sur AS (SELECT * FROM nod WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.k = nod.k + 1 AND parent = nod.kmer)),
bins AS (SELECT k, (length(bin(coverage)) - 1)::BIGINT AS bin, count(*) AS n FROM cnt GROUP BY ALL),
hook AS (SELECT k, coalesce((SELECT bin FROM bins b WHERE b.k = a.k AND bin >= 1 ORDER BY (length(bin(n)) - 1) * bin DESC, bin LIMIT 1), 0) AS hook FROM (SELECT DISTINCT k FROM bins) a)
SELECT sur.k, kmer, coverage, abs(length(bin(coverage)) - 1 - hook)::BIGINT AS off FROM sur JOIN hook ON hook.k = sur.k ORDER BY off, sur.k DESC, kmer LIMIT 20""")
def surface_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.surface_seeds(ref_nodes(spark, sf_dir, 4, 8), 20).select("k", "kmer", "coverage", "off")


HOOKS = """bins AS (SELECT k, (length(bin(coverage)) - 1)::BIGINT AS bin, count(*) AS n FROM cnt GROUP BY ALL),
hook AS (SELECT k, coalesce((SELECT bin FROM bins b WHERE b.k = a.k AND bin >= 1 ORDER BY (length(bin(n)) - 1) * bin DESC, bin LIMIT 1), 0) AS hook FROM (SELECT DISTINCT k FROM bins) a)"""


@query(f"""WITH {nodes_sql(4, 8, REFS)}, {CHILDREN}, {HOOKS}, near AS (SELECT chi.k, chi.kmer, dir FROM chi JOIN nod USING (k, kmer) WHERE pow((coverage - child_coverage)::DOUBLE / greatest(coverage, child_coverage, 1), 2) < 0.0025
GROUP BY ALL HAVING count(*) > 1) SELECT nod.k, kmer, coverage FROM nod JOIN hook ON hook.k = nod.k WHERE length(bin(coverage)) - 1 = hook AND NOT EXISTS (SELECT 1 FROM near WHERE near.k = nod.k AND near.kmer = nod.kmer)
ORDER BY nod.k DESC, kmer LIMIT 20""")
def unambiguous_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.unambiguous_seeds(ref_nodes(spark, sf_dir, 4, 8), 0.0025, 20).select("k", "kmer", "coverage")


@query(f"""WITH {nodes_sql(4, 8, REFS)}, sub AS (SELECT DISTINCT j AS k, {canon('substr(kmer, p, j)')} AS kmer FROM (SELECT kmer, j, unnest(range(1, k - j + 2)) AS p FROM (SELECT k, kmer, unnest(range(4, k + 1)) AS j FROM nod WHERE k = 8 AND coverage > 1)))
SELECT k, kmer, coverage FROM nod ANTI JOIN sub USING (k, kmer) ORDER BY k DESC, kmer LIMIT 20""")
def next_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 4, 8)
    return seeds.next_seeds(nodes, nodes.where("k = 8 AND coverage > 1"), 20).select("k", "kmer", "coverage")


def steady_sql(name: str, start: str) -> str:
    """A recursive table (seed, w, used, grown, covs) that takes the only close next k-mer, if unused."""
    ways = f"SELECT seed, w, used, grown, covs, substr(w, 2) || c AS next, {canon('substr(w, 2) || c')} AS kmer FROM {name}, (SELECT unnest(['A', 'C', 'G', 'T']) AS c)"
    close = f"SELECT x.*, b.coverage, count(*) OVER (PARTITION BY seed) AS n FROM ({ways}) x JOIN cnt a ON a.kmer = {canon('x.w')} JOIN cnt b ON b.kmer = x.kmer WHERE pow((a.coverage - b.coverage)::DOUBLE / greatest(a.coverage, b.coverage, 1), 2) < 0.3"
    return f"""{name}(seed, w, used, grown, covs) AS ({start} UNION ALL SELECT seed, next, list_append(used, kmer), grown || right(next, 1), list_append(covs, coverage) FROM ({close}) WHERE n = 1 AND NOT list_contains(used, kmer)),
{name}_end AS MATERIALIZED (SELECT seed, max_by(used, len(used)) AS used, max_by(grown, len(used)) AS grown, max_by(covs, len(used)) AS covs FROM {name} GROUP BY seed)"""


@query(f"""WITH RECURSIVE {counts_sql(16, 16, REFS)}, {steady_sql("fore", "SELECT kmer, kmer, [kmer], '', []::BIGINT[] FROM cnt")},
{steady_sql("hind", f"SELECT seed, {rc('seed')}, used, '', []::BIGINT[] FROM fore_end")},
whole AS (SELECT h.seed, {rc('h.grown')} || h.seed || f.grown AS seq, list_concat(list_concat(h.covs, f.covs), list_resize([]::BIGINT[], 16, cnt.coverage)) AS covs FROM hind_end h JOIN fore_end f ON f.seed = h.seed JOIN cnt ON cnt.kmer = h.seed)
SELECT seed, seq, length(seq) AS length, round(list_avg(covs), 6) AS average, round(list_stddev_pop(covs), 6) AS deviation, length(seq) >= 500 AS is_long FROM whole WHERE length(seq) > 150""")
def steady_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ref_nodes(spark, sf_dir, 16, 16)
    out = seeds.steady_contigs(nodes, nodes.select(F.col("kmer").alias("seq")), 0.3)
    return out.withColumn("average", F.round("average", 6)).withColumn("deviation", F.round("deviation", 6))


@query()
def extracted_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.extract_all(ref_nodes(spark, sf_dir, 7, 15))


@query(f"""WITH {counts_sql(5, 9, REFS)}, seen AS MATERIALIZED (SELECT read_id, k, p, {canon('substr(seq, p, k)')} AS kmer FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS p FROM reads, (SELECT unnest([5, 7, 9]) AS k) WHERE length(seq) >= k)),
gap AS MATERIALIZED (SELECT seen.* FROM seen WHERE NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.k = seen.k AND cnt.kmer = seen.kmer AND coverage > 1))
SELECT read_id, k::BIGINT AS k, p - 1 AS pos, kmer FROM seen WHERE NOT EXISTS (SELECT 1 FROM gap WHERE gap.read_id = seen.read_id AND gap.p >= seen.p AND gap.p + gap.k <= seen.p + seen.k)""")
def visit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.reference_reads(spark, sf_dir)
    nodes = stage(kmers.count_kmers(rows, 5, 9), "counts").where("coverage > 1")
    return visits.unbroken_windows(rows, [5, 7, 9], nodes).select("read_id", F.col("k").cast("long"), F.col("pos").cast("long"), "kmer")


@query()
def greedy_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.assemble_all(ref_nodes(spark, sf_dir, 12, 14), 12)


# ---- sinks, sources, streaming


@query(f"WITH {REFS} SELECT read_id, '>' || read_id || chr(10) || seq AS record FROM reads")
def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reference_reads(spark, sf_dir).select("read_id", fastx.fasta_text(F.col("read_id").cast("string"), F.col("seq")).alias("record"))


@query(f"WITH {QREADS} SELECT read_id, '@' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM qreads")
def fastq_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.quality_reads(spark, sf_dir).select("read_id", fastx.fastq_text(F.col("read_id").cast("string"), F.col("seq"), F.col("qual")).alias("record"))


@query(f"WITH {REFS} SELECT read_id, array_to_string(list_transform(range(0, (length(seq) + 79) // 80), lambda i: substr(seq, i * 80 + 1, 80)), chr(10)) AS record FROM reads")
def wrap80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reference_reads(spark, sf_dir).select("read_id", fastx.wrapped("seq").alias("record"))


@query(f"WITH {REFS} SELECT read_id::VARCHAR AS name, seq FROM reads")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "fasta")
    rows = X.reference_reads(spark, sf_dir)
    fastx.write_text(rows.select(fastx.fasta_text(F.col("read_id").cast("string"), fastx.wrapped("seq", 60)).alias("value")), path)
    return fastx.read_fastx(spark, path, ("name", "seq"))


@query(f"WITH {QREADS} SELECT read_id::VARCHAR AS name, seq, qual FROM qreads")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "fastq")
    fastx.write_text(X.quality_reads(spark, sf_dir).select(fastx.fastq_text(F.col("read_id").cast("string"), F.col("seq"), F.col("qual")).alias("value")), path)
    return fastx.read_fastx(spark, path)


@query(f"WITH {nodes_sql(4, 8, REFS)} SELECT * FROM nod")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "graph")
    graphs.save_graph(kmers.build_nodes(X.reference_reads(spark, sf_dir), 4, 8), path)
    return graphs.load_graph(spark, path)


@query(f"WITH {counts_sql(4, 6, REFS)} SELECT * FROM cnt")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = staged_path(spark, "stream")
    schema = X.table(spark, sf_dir, "benchmark").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(sf_dir)
    counted = streams.count_stream(source.select(S.project_text("text").alias("seq")), 4, 6)
    writer = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(out)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
