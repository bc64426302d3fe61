import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import chat, common, decontam, langid, lines, mixing, pii, quality, queries, rules, simhash, suffixes

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, long lines, repeated rows, a repeated id with another text.
ODD = [None, "", " \n\t ", "\n", "one", "é ß", "x" * 30_000, "ab " * 5_000, "\n".join(["the same line of text, again"] * 40)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_docs(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[7], (4, "another text under the same id", "en", "s", 1), (None, "no id at all here", "en", "s", 2)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns whose names the operators might use themselves."""
    for name in ("score", "lang_pred", "epoch", "block", "n_lines", "spans", "n_tokens", "th", "h", "fp", "node", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- op1


def measured(t):
    w, t = words(t), t or ""
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    full = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(repeated)


def test_op1_measures_match_brute_force(spark):
    r = random.Random(1)
    docs = [*ODD, *(sentence(r, n) for n in (3, 30, 300)), "a b c a b c", "a a a a", "# $ | x\nx\n x\nx", "a b c d a b c e a b c"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in rules.quality_rules(df).collect()}
    assert got == {i: measured(t) for i, t in enumerate(docs)}


def test_op1_em_finds_accuracies():
    r = random.Random(2)
    truth = [0.95, 0.9, 0.7] + [0.8] * (len(rules.RULES) - 3)
    votes = Counter()
    for _ in range(20_000):
        good = r.random() < 0.7
        votes[tuple(0 if r.random() < 0.3 else (1 if good else -1) * (1 if r.random() < a else -1) for a in truth)] += 1
    share, accuracy = rules.estimate(sorted(votes.items()))
    assert abs(share - 0.7) < 0.03 and max(abs(a - b) for a, b in zip(accuracy, truth, strict=True)) < 0.03


def test_op1_separates_labels_and_handles_odd_input(spark):
    rows = rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert sum(x.kept == (x.quality == 1) for x in rows) >= 0.98 * len(rows)
    out = rules.quality_rules(clashing(odd_docs(spark))).collect()
    assert len(out) == len(ODD) + 4 and all(x.base_failed for x in out if x.n_words < 50)
    assert rules.quality_rules(empty_docs(spark)).count() == 0


# ---- op2


def test_op2_bisection():
    t = mixing.bisect_exponent([1000, 10], max_repeats=4)
    assert abs((10 / 1000) ** (t - 1) - 4) < 1e-6
    assert mixing.bisect_exponent([1000, 500], max_repeats=4) == 0
    assert mixing.bisect_exponent([], 4) == 1 and mixing.bisect_exponent([0, 5], 4) == 0
    t = mixing.bisect_exponent([800, 100, 100], target_entropy=0.9)
    p = np.array([0.8, 0.1, 0.1]) ** t
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.9) < 1e-6


def mixed_key(epoch, doc_id):
    """A pass orders blocks (three digits of a document's hash), and a block its documents."""
    h = hashlib.md5(f"mix-{doc_id}".encode()).hexdigest()
    return hashlib.md5(f"mix-{epoch}-{h[:3]}".encode()).hexdigest()[:12] + "-" + h


@pytest.mark.parametrize("options", [{"budget": 3000}, {"budget": 20_000, "max_repeats": 2.0}, {"target_entropy": 0.9}, {"budget": 777, "target_entropy": 1.05}])
def test_op2_matches_brute_force_with_budget_and_entropy(spark, options):
    r = random.Random(6)
    rows = [(i, sentence(r, r.randrange(0, 30)), "en", ["big", "mid", "low"][0 if i < 300 else 1 if i < 380 else 2], 0) for i in range(420)]
    tokens, of = Counter(), {}
    for i, text, _, source, _ in rows:
        tokens[source] += len(words(text))
        of.setdefault(source, []).append((i, len(words(text))))
    t = mixing.bisect_exponent(list(tokens.values()), options.get("max_repeats", 4.0), options.get("target_entropy"), options.get("budget"))
    parts = {s: (n / max(tokens.values())) ** t for s, n in tokens.items()}
    whole = options.get("budget", max(tokens.values()) * sum(parts.values()))
    want = set()
    for s, docs in of.items():
        passes = round(parts[s] / sum(parts.values()) * whole / tokens[s], 6)
        rest, full = math.floor(round((passes - math.floor(passes)) * tokens[s], 3)), math.floor(passes)
        want |= {(i, e) for i, _ in docs for e in range(full)}
        for i, n in sorted(docs, key=lambda x: mixed_key(full, x[0])) if rest else ():
            if n > rest:
                break
            rest -= n
            want.add((i, full))
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), **options).select("doc_id", "epoch").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_op2_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, 6, 7, 8)], "doc_id long, text string, source string, passes int, last_key int, __source int, `of` int")
    assert tuple(mixing.mix_sources(df).select("passes", "last_key", "__source", "of").first()) == (5, 6, 7, 8)


def test_op2_passes_and_permutations(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, 1 + i % 9), "en", ["big", "mid", None][0 if i < 600 else 1 if i < 700 else 2], 0) for i in range(730)]
    rows = clashing(spark.createDataFrame(rows, DOCS))
    out = mixing.mix_sources(rows, max_repeats=3.0).select("doc_id", "source", "epoch", "order_key", "block", "n_tokens").collect()
    size = Counter()
    for x in rows.select("source", "text").collect():
        size[x.source] += len(words(x.text))
    taken, times = Counter(), Counter()
    for x in out:
        taken[x.source] += x.n_tokens
        times[x.doc_id] += 1
        assert x.order_key == mixed_key(x.epoch, x.doc_id) and x.block == x.order_key[13:16]
    assert min(times.values()) >= 1 and len(times) == 730 and max(times.values()) <= 4
    t = mixing.bisect_exponent(list(size.values()), 3.0)
    for s, n in size.items():
        want = n * (n / max(size.values())) ** (t - 1)
        assert want - 9 <= taken[s] <= want + 1
    partial = [x for x in out if x.source == "mid"]
    last = max(x.epoch for x in partial)
    keys = sorted(mixed_key(last, i) for i in range(600, 700))
    got = sorted(x.order_key for x in partial if x.epoch == last)
    assert got == keys[: len(got)]


def test_op2_budget_and_odd_input(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, sentence(r, 10), "en", f"s{i % 3}", 0) for i in range(300)], DOCS)
    assert mixing.mix_sources(df, budget=1500).agg(F.sum("n_tokens")).first()[0] == 1500
    out = mixing.mix_sources(clashing(odd_docs(spark))).collect()
    assert {x.doc_id for x in out} == {*range(len(ODD)), None}
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(df, max_sources=2)


# ---- op3


def weighted(a, b):
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


def shingles(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def test_op3_matches_brute_force(spark):
    r = random.Random(5)
    items = [(i, sentence(r, n)) for i, n in enumerate([40, 25, 12, 12, 5, 3, 80])] + [(7, None), (8, "")]
    texts = [sentence(r, 100) for _ in range(6)]
    for i, t in items[:7]:
        w = t.split()
        texts.append(f"{sentence(r, 30)} {t.upper()}! {sentence(r, 30)}")
        for j in (len(w) // 2, 1):
            w[j] = "changed"
            texts.append(f"{sentence(r, 9)} {' '.join(w)} {sentence(r, 9)}")
        texts.append(" ".join(t.split()[1:]))
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        w = decontam.words_of(t)
        for i, x in items[:7]:
            v = x.split()
            n = min(len(v), len(w))
            best = max(weighted(shingles(w[s : s + n], min(5, len(v))), shingles(v, min(5, len(v)))) for s in range(len(w) - n + 1))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    for block in (20_000, 2):
        got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontam.contamination(docs, bench, block_items=block).collect()}
        assert got == want and len(want) >= 12
    left = {x.doc_id for x in decontam.decontaminate(docs, bench).collect()}
    assert left == {*range(len(texts) + 2)} - {d for d, _ in want}


@pytest.mark.parametrize("radius", [0, 2, 9, 23])
def test_op3_blocks_miss_nothing_within_the_radius_and_select(radius):
    r = np.random.default_rng(4)
    items = [(i, " ".join(f"w{r.integers(10**9)}" for _ in range(12))) for i in range(150)]
    index = decontam.ItemIndex(items, 5, 0.8, radius)
    prints = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for p in range(0, 3000, 3):  # some at every distance up to the radius
        flips = r.choice(64, r.integers(0, radius + 2), replace=False)
        prints[p] = index.prints[p % 150] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    at, item = index.near(prints, 12)
    want = np.nonzero(np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= radius)
    assert sorted(zip(at.tolist(), item.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))
    _, tables = index.by_length[12]
    open_share = 1 - np.prod([1 - np.unpackbits(t, axis=1, count=150).mean() for t in tables])
    assert open_share < 0.4


def test_op3_odd_input(spark):
    bench = spark.createDataFrame([(0, "no id at all here"), (1, "one")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contamination(clashing(odd_docs(spark)), bench).collect()}
    assert got == {(None, 0), (4, 1)}
    assert decontam.contamination(odd_docs(spark), bench.limit(0)).count() == 0
    assert decontam.contamination(empty_docs(spark), bench).count() == 0


# ---- op4


def brute_repeats(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        spans = suffixes.merged([(i, i + n) for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1])
        edges = [0, *(e for s in spans for e in s), len(t)]
        kept = b"".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "classes", "size"), [(20, 20_000, 1 << 19), (90, 1, 1 << 19), (70, 20_000, 500), (2, 50, 1 << 19)])
def test_op4_matches_brute_force(spark, length, classes, size):
    r = random.Random(length)
    parts = [sentence(r, r.randrange(1, 40)) for _ in range(12)]
    texts = [" ".join(r.choice(parts) if r.random() < 0.4 else sentence(r, 15) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    texts += [texts[0], texts[1] + "!", "a" * 300, "ab" * 100, "é" * 60, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(df, length, classes, size).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], length)


def test_op4_matches_brute_force_at_the_contracts_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, (x.text or "").encode()) for x in docs.collect()]
    seen = Counter(hash(t[i : i + 400]) for _, t in rows for i in range(len(t) - 399))
    want = {}
    for d, t in rows:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(t, dtype=np.uint8)[~covered])
        want[d] = len(t), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()
    out = suffixes.remove_repeats(docs.repartition(7)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out} == want and sum(x[1] > 0 for x in want.values()) > 50


def test_op4_odd_input(spark):
    out = suffixes.remove_repeats(clashing(odd_docs(spark)), 50).collect()
    assert len(out) == len(ODD) + 4
    assert {x.n_removed for x in out if x.doc_id == 7} == {15_000} and {x.n_removed for x in out if x.doc_id == 0} == {0}
    assert suffixes.remove_repeats(empty_docs(spark)).count() == 0


# ---- op5


def fingerprint(t, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_op5_matches_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    texts = {x.doc_id: x.text for x in rows}
    r = random.Random(6)
    for i in range(40):
        w = sentence(random.Random(7), 300).split()
        w[r.randrange(300)] = f"v{i % 20}"
        texts[10_000 + i] = " ".join(w)
    texts |= {20_000 + i: t for i, t in enumerate(ODD)}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = linked(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(set(prints.values()))


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_op5_bit_slices(radius):
    r = np.random.default_rng(radius)
    centre = r.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (400, 5)).astype(np.uint64), axis=1)
    fp = centre[r.integers(0, 8, 400)] ^ flips * r.integers(0, 2, 400).astype(np.uint64)
    ends = np.repeat(np.array([1, 3, 200, 270, 400]), [1, 2, 197, 70, 130])
    a, b = simhash.bit_sliced_pairs(fp, ends, radius)
    want = {(i, j) for i in range(400) for j in range(i + 1, ends[i]) if int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_op5_chunks_lose_no_link(spark):
    rows = [(0, 0, i, i) for i in range(0, 512, 2)] + [(0, 1, 1 << 40, 900)]
    df = spark.createDataFrame(rows, "t int, key long, fp long, node long")
    want = linked([x[3] for x in rows], lambda a, b: (a ^ b).bit_count() <= 1 and 900 not in (a, b))
    for chunk in (4096, 16):
        edges = [(x.src, x.dst) for x in simhash.block_edges(df, 1, chunk).collect()]
        assert len(edges) < 20 * len(rows)
        have = {frozenset(e) for e in edges}
        assert linked([x[3] for x in rows], lambda a, b, have=have: frozenset((a, b)) in have) == want


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(8)
    texts = []
    for _ in range(25):
        base = sentence(r, r.randrange(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(0, 4)):
            w = list(base)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [texts[0], None, "", "a b"]
    sets = [{*shingles((t or "").lower().split())} for t in texts]
    jaccard = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    want = linked(list(range(len(texts))), lambda a, b: jaccard(a, b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (1024, 2):
        assert {x.doc_id: x.group_id for x in simhash.near_duplicates(df, chunk=chunk).collect()} == want


def test_near_duplicates_where_a_line_repeats_unequally_or_texts_are_short(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    pairs = []
    for n, times in [(500, 20)] * 20 + [(180, 10)] * 20 + [(100, 6)] * 20:
        body, line = [word() for _ in range(n)], [word() for _ in range(10)]
        pairs.append((body + line * 2, body + line * times))
    pairs += [(w[:8], w) for w in ([word() for _ in range(9)] for _ in range(2000))]  # sets of 4 and 5 shingles
    for a, b in pairs:
        x, y = {*shingles(a)}, {*shingles(b)}
        assert len(x & y) >= 0.8 * len(x | y)
    texts = [" ".join(t) for p in pairs for t in p]
    got = {x.doc_id: x.group_id for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_band_keys_lose_no_pair_at_the_threshold():
    r = np.random.default_rng(3)
    sets = r.integers(0, 1 << 63, (40_000, 5), dtype=np.uint64)
    assert all((simhash.band_keys(u) == simhash.band_keys(u[:4])).any() for u in sets)


def test_near_duplicates_follow_exact_links_only(spark):
    """A chain of texts, each at 0.6 to the next: candidates, but no links; and one at 0.85 in its middle."""
    r = random.Random(21)
    w = [f"w{r.randrange(10**9)}" for _ in range(2400)]
    texts = [" ".join(w[i : i + 200]) for i in range(0, 2200, 50)]
    texts.insert(20, " ".join(w[950:1135]))
    sets = [{*shingles(t.split())} for t in texts]
    want = linked(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {x.doc_id: x.group_id for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == len(texts) - 1


def test_op5_odd_input(spark):
    out = simhash.simhash_components(clashing(odd_docs(spark))).collect()
    assert len(out) == len(ODD) + 4 and {x.component_id for x in out if x.doc_id in (0, 1, 2, 3)} == {0}
    assert len(simhash.near_duplicates(odd_docs(spark)).collect()) == len(ODD) + 4
    assert simhash.simhash_components(empty_docs(spark)).count() == 0 and simhash.near_duplicates(empty_docs(spark)).count() == 0


# ---- op6


def test_op6_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit_languages(docs)).where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & F.col("lang").isNotNull()).collect()
    assert sum(x.lang == x.lang_pred for x in out) >= 0.97 * len(out) and all(0 <= x.score <= 1 for x in out)


def test_op6_kernel_is_shared_grams():
    p = langid.presence(["abc abd", "abd xyz", "Abc Abd"])
    a, b = ({*langid.grams(t).tolist()} for t in ("abc abd", "abd xyz"))
    assert abs(float(p[0] @ p[1]) - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-5 and abs(float(p[0] @ p[2]) - 1) < 1e-5


def test_op6_odd_input(spark):
    model = langid.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    out = langid.identify(clashing(odd_docs(spark)), model).collect()
    assert {x.lang_pred for x in out if x.text is None or not re.search(r"[^\W\d_]", x.text)} == {"und"}
    assert {x.lang_pred for x in out} <= {"en", "de", "und"}
    nothing = langid.fit_languages(empty_docs(spark))
    assert {x.lang_pred for x in langid.identify(odd_docs(spark), nothing).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), model).count() == 0


# ---- op7


def test_op7_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [x for x in out if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    good, bad = ([x.score for x in held if x.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s >= 0.3 for s in bad]) < 0.2
    odd = quality.score_quality(clashing(odd_docs(spark)), model).collect()
    assert len(odd) == len(ODD) + 4 and all(0 <= x.score <= 1 for x in odd)
    assert quality.score_quality(empty_docs(spark), model).count() == 0


def test_op7_with_few_labels_or_none(spark):
    docs = odd_docs(spark)
    for labels in ([(4, 1, 0)], []):
        model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {x.score for x in quality.score_quality(docs, model).collect()} == {0.5}
    few = spark.createDataFrame([(i, f"text {i} of class {i % 2}") for i in range(40)], "doc_id long, text string")
    model = quality.fit_quality(few, few.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert all(0 <= x.score <= 1 for x in quality.score_quality(few, model).collect())


# ---- op8


def dropped(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 3 and i < max(holders[key(x)]))]
        out[i] = len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def test_op8_matches_brute_force(spark):
    r = random.Random(9)
    common = [sentence(r, 5), "Übung macht den Meister sagt man", "x" * 19, "y" * 20]
    rows = [(i, "\n".join(r.choice(["  " + c.upper(), c, c + "\r", sentence(r, 4), ""]) for c in common for _ in range(2))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    for hot in (1000, 2):
        out = lines.dedup_lines(df, hot=hot).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
        assert {x.doc_id: (x.n_lines, x.n_dropped, x.h) for x in out} == dropped(rows)
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in lines.line_digest(df).collect()} == dropped(rows)


def test_op8_runs_by_batches(spark):
    runs = lines.LineRuns(spark, fanout=2)
    seen = set()
    for b in range(5):
        batch = [(10 * b + i, f"a line that all batches share\nline number {i + b} of this batch's own") for i in range(3)]
        out = {x.doc_id: x.text for x in runs.dedup_batch(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
        for i, t in batch:
            assert out[i] == "\n".join(x for x in t.split("\n") if x not in seen)
        seen |= {x for _, t in batch for x in t.split("\n")}
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.counts().count() == len(seen)
    assert lines.line_digest(empty_docs(spark)).count() == 0


# ---- op9


def test_op9_collapses_snapshots(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(1, k, *t) for k, t in enumerate(turns[:2])] + [(2, 5 * k, *t) for k, t in enumerate(turns)] + [(3, k, *t) for k, t in enumerate(turns)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "bye"), (5, 0, "assistant", "hi"), (6, 0, "user", "hi"), (7, 0, None, "hi"), (7, 0, "user", "a")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: (x.n_turns, x.rendered) for x in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 7}
    assert got[2] == (4, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_op9_equal_turns_and_roles_render_in_the_order_that_prefixes_have(spark):
    texts = sorted("abcdefgh", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert texts != sorted(texts)
    rows = [(i, 0, "user", t) for i in range(1, 9) for t in random.Random(i).sample(texts[:i], i)]
    rows += [(9, 0, "user", texts[1]), (None, 3, "user", "z"), (None, None, "user", None)]
    got = {x.conv_id: (x.n_turns, re.findall(r"user\n(.*)<\|im_end", x.rendered)) for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {8: (8, texts), 9: (1, [texts[1]]), None: (2, ["", "z"])}


# ---- op10

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "email": (EMAIL, lambda s: True),
        "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 14 <= len(digits(s)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0),
        "phone": (PHONE, lambda s: 10 <= len(digits(s)) <= 15),
    }
    found = [(k, m.start(), m.end()) for k, (p, ok) in checks.items() for m in p.finditer(t or "") if ok(m[0])]
    return sorted(found, key=lambda x: (x[1], list(checks).index(x[0])))


def test_op10_base_spans_match_the_patterns():
    r = random.Random(10)
    bits = ["a.b@c.de", "@x.y@z.w", "a@b@c.d.e", "1.2.3.4.5.6.7.8", "10.0.0.256", "0010.0.0.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1+12345678901", " ", "..", "é", "x", "+", "@", "-", "12", "a@b.c-d.", "4242424242424242424"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 12)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ODD:
        assert pii.base_spans(t) == brute_spans(t)


def test_op10_terms_inside_spans():
    r = random.Random(12)
    for _ in range(300):
        spans = sorted((r.randrange(40), r.randrange(1, 9)) for _ in range(r.randrange(12)))
        covered = pii._union([("ip", s, s + n) for s, n in spans])
        a = r.randrange(45)
        b = a + r.randrange(1, 6)
        assert pii._touches(covered, a, b) == any(s < b and a < s + n for s, n in spans)


def test_op10_terms(spark):
    r = random.Random(11)
    secret, texts = "jane@corp.example", []
    for i in range(60):
        w = sentence(r, 12)
        texts.append(f"{w} whistleblower {secret} {w}" if i < 4 else f"{w} unrelated{i}@mail.example" if i < 8 else w)
    texts.append("the whistleblower alone, without a name")
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for most in (200_000, 0):
        terms = {x.t: x.disclosure for x in pii.disclosing_terms(df, max_terms=most).collect()}
        assert set(terms) == {"whistleblower"}
        n, nt, ne, both = 61, 5, 4, 4
        assert abs(terms["whistleblower"] - np.log(both * n / (nt * ne)) / np.log(n / ne)) < 0.1
        got = {x.doc_id: x.spans for x in pii.find_pii(df, max_terms=most).collect()}
        assert [(s.kind, s.action) for s in got[60]] == [("term", "generalise")] and {s.kind for s in got[0]} == {"email", "term"} and got[20] == []
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert clean[60] == "the [TERM] alone, without a name" and secret not in "".join(clean.values())


def test_op10_secrets():
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'token = "{token}" and 4111111111111111 to {"x1" * 20}@mail.example, {"ab" * 20}, {"a1" * 20}'
    assert [(k, text[s:e]) for k, s, e in pii.secret_spans(text, pii.base_spans(text))] == [("secret", token)]
    assert pii.sanitised(text, pii.all_spans(text, {}, 0.97)).startswith('token = "[SECRET]" and [CARD] to [EMAIL]')


def test_op10_terms_of_classes_act_on_the_table(spark):
    """What stands beside every secret of the documents is found from the class, as no value recurs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    terms = {x.t: x.disclosure for x in pii.disclosing_terms(docs).collect()}
    assert terms.get("token", 0) >= 0.97
    rows = pii.pii_digest(docs).collect()
    marked = [x for x in rows if x.n_term]
    assert marked and sum(x.n_secret > 0 for x in rows) >= 5
    assert sum(x.n_email + x.n_ip + x.n_card + x.n_phone + x.n_secret == 0 for x in marked) <= 0.01 * len(rows)


def test_op8_keeps_columns_of_any_name(spark):
    line = "a line of over twenty letters"
    df = spark.createDataFrame([(i, line, 7, 8, 9) for i in range(3)], "doc_id long, text string, `of` int, away int, __of int")
    out = lines.dedup_lines(df).select("doc_id", "text", "of", "away", "__of").collect()
    assert sorted(map(tuple, out)) == [(0, "", 7, 8, 9), (1, "", 7, 8, 9), (2, line, 7, 8, 9)]


def test_op8_runs_hold_a_key_once_and_are_not_shuffled(spark):
    r = random.Random(12)
    texts = [(i, "\n".join(f"line number {r.randrange(40)} of the table" for _ in range(6))) for i in range(60)]
    keys = lines.document_keys(spark.createDataFrame(texts, "doc_id long, text string"), 20).cache()
    runs = lines.LineRuns(spark, fanout=3)
    for i in range(5):
        runs.add(keys.where(F.col("doc_id") % 5 == i))
    held = [x for level in runs.levels for x in level]
    assert [len(x) for x in runs.levels] == [2, 1] and sum(x.count() for x in held) == keys.select("h1", "h2").distinct().count()
    assert "Exchange" not in runs.unseen(held[0])._jdf.queryExecution().executedPlan().toString()
    want = {(x.h1, x.h2): (x.n, x.m) for x in keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()}
    assert {(x.h1, x.h2): (x.n_docs, x.max_doc) for x in runs.counts().collect()} == want


def test_op8_runs_write_a_batch_once(spark):
    keys = spark.createDataFrame([(k, -k, d) for d in range(12) for k in range(d % 5, 9)] + [(7, -7, None)], "h1 long, h2 long, doc_id long")
    runs = lines.LineRuns(spark, fanout=3)
    for i in range(4):
        runs.add(keys.where(F.coalesce("doc_id", F.lit(0)) % 4 == i))
    got = {(x.h1, x.h2): (x.n_docs, x.max_doc) for x in runs.counts().collect()}
    want = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("m")).collect()
    assert got == {(x.h1, x.h2): (x.n, x.m) for x in want}
    assert runs._written == 4 + 1  # the batches and one compaction; the second table of a batch and that of the sums are gone


def test_op10_digest_and_odd_input(spark):
    texts = [*ODD, "a@b.cd 1.2.3.4", "call +49 30 1234567 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.pii_digest(df).collect():
        want = brute_spans(texts[x.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and x.spans == joined
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in pii.KINDS)
    assert pii.pii_digest(clashing(odd_docs(spark))).count() == len(ODD) + 4
    assert {x.n_spans for x in pii.pii_digest(clashing(odd_docs(spark))).collect()} == {0}
    assert pii.pii_digest(empty_docs(spark)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(ODD)], DOCS)
    now = docs.select(*corpus_pipeline.COLUMNS).unionByName(extra)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, clashing(now), DATA).cache()
        ids = {x.doc_id for x in out.select("doc_id").collect()}
        before = {x.doc_id: x.text for x in now.collect()}
        assert ids <= set(before)
        assert name == "mixing" or out.columns == corpus_pipeline.COLUMNS
        if name == "quality classifier":
            labels = {x.doc_id: x for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            good = [i for i, x in labels.items() if x.quality == 1 and i in before]
            assert sum(i in ids for i in good) > 0.95 * len(good) and len(ids) < len(before)
            assert {x.doc_id: x.text for x in out.collect()}.items() <= before.items()
        elif name == "line dedup":
            assert ids == set(before)
        elif name == "simhash near-dedup":
            assert len({before[i] for i in ids}) == len(ids)
            sets = {i: {*shingles(words((before[i] or "").lower()))} for i in before}
            for i in set(before) - ids:
                assert any(sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in before if j != i)
        elif name == "mixing":
            assert ids == set(before)
        now = out.select(*corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, DATA).where("text IS NULL").count() == 0


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    for name, f in corpus_pipeline.STAGES:
        out = f(spark, clashing(empty_docs(spark)), DATA)
        assert out.count() == 0, name
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)


def test_near_duplicate_stage_finds_what_brute_force_finds(spark):
    import corpus_pipeline

    r = random.Random(11)
    base = [sentence(r, r.randrange(40, 160)) for _ in range(25)]
    texts = list(base)
    for t in base[:15]:
        for _ in range(3):
            w = t.split(" ")
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    texts += base[15:20]
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    sets = [{*zip(*(words(t)[j:] for j in range(5)), strict=False)} for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert 25 < len(set(group)) < len(texts)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(group))


def test_queries_are_named_and_explained():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(names)


def test_candidates_texts_are_found_without_a_shuffle(spark):
    rows = spark.range(0, 20_000).select(F.col("id").alias("node"), F.lit("some text").alias("text"))
    wanted = rows.where("node % 50 = 7").select("node")
    for bits, most in ((1 << 25, 402), (1 << 12, 4_000)):
        found = simhash.likely(rows, wanted, bits)
        nodes = {x.node for x in found.collect()}
        assert {x.node for x in wanted.collect()} <= nodes and len(nodes) < most and found.columns == ["node", "text"]
        assert not re.search(r"hashpartitioning\(node", found._jdf.queryExecution().executedPlan().toString())


def test_near_duplicates_leave_no_shuffle_files_and_no_spent_tables(spark):
    def there(label):
        jvm, base = spark._jvm, common.shared_dir(spark)
        found = jvm.org.apache.hadoop.fs.Path(f"{base}/staged/{spark.sparkContext.applicationId}/{label}-*")
        return {str(x.getPath()) for x in found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)}

    labels = ("candidates", "shingle-sets", "first-links")
    before = [there(x) for x in labels]
    texts = [" ".join(random.Random(i // 2).choices("abcdefgh", k=90)) + " end" * (i % 2) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.group_id for x in simhash.near_duplicates(docs).collect()} == {i: i - i % 2 for i in range(40)}
    assert [there(x) for x in labels] == before
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    common.stage(docs.repartition(3, "doc_id").groupBy(F.length("text").alias("n")).count(), "counts")
    assert tracker.shuffleStatuses().size() <= held
