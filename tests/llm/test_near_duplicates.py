"""Near duplicates of five-word shingles against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareknit.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_pairs(texts):
    sets, ids = {i: shingles(t) for i, t in texts}, sorted(i for i, _ in texts)
    return {(a, b) for a in ids for b in ids if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    """Texts of 40 to 400 words, and copies of them with 0 to 10 words in a hundred changed."""
    rng, rows = random.Random(12), []
    for k in range(60):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([40, 120, 400]))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, rng.randint(2, 9)):
            rate = rng.choice([0.01, 0.02, 0.03, 0.1])
            rows.append((10 * k + c, " ".join(w if rng.random() >= rate else f"x{rng.randrange(10**6)}" for w in base)))
    return rows


def classes_of(docs):
    marked = docs.select("doc_id", "text", simhash.signature(F.col("text")).alias("s")).select("doc_id", "text", "s.*").cache()
    return marked, {r.doc_id: r.node for r in marked.select("doc_id", "node").collect()}


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(s) for s in out.values()}


def test_stage_leaves_one_of_each_group(spark, sf_dir, copies):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in copies], DOCS)
    assert len(brute_pairs(copies)) > 150
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()}
    assert set(kept) == roots([i for i, _ in copies], brute_pairs(copies)) and all(dict(copies)[i] == t for i, t in kept.items())


def test_links_join_what_brute_force_joins(spark, copies):
    marked, node_of = classes_of(spark.createDataFrame(copies, "doc_id long, text string"))
    want = {(node_of[a], node_of[b]) for a, b in brute_pairs(copies) if node_of[a] != node_of[b]}
    nodes = marked.select("node", "fp", "keys").dropDuplicates(["node"])
    got = {(r.a, r.b) for r in simhash.similar_links(nodes, marked.select("node", "text")).collect()}
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in want}
    assert components(set(node_of.values()), got) == components(set(node_of.values()), want)


def test_members_far_from_the_head(spark, monkeypatch):
    """A chain of texts, each like the next only, all under the same keys: heads join few, the second look joins all."""
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[: 300 - 12 * i] + [f"y{k}" for k in range(12 * i)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked, node_of = classes_of(docs)
    assert len(brute_pairs(rows)) < 66 and roots(range(12), brute_pairs(rows)) == {0}
    nodes = marked.select("node", "fp", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("keys"))
    got = {(r.a, r.b) for r in simhash.similar_links(nodes, marked.select("node", "text")).collect()}
    assert len(components(set(node_of.values()), got)) == 1


def test_versions_changed_too_much_make_few_pairs(spark, monkeypatch):
    """Hundreds of versions of one text, most of them no near duplicates of any other, share keys but hardly meet."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))] + [(i, " ".join(w if rng.random() > rng.choice([0.01, 0.05, 0.08]) else f"y{rng.randrange(10**6)}" for w in base)) for i in range(1, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, own = [], simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda pairs, texts: seen.append(pairs.count()) or own(pairs, texts))
    assert {r.doc_id for r in simhash.one_of_each_group(docs).collect()} == roots(range(500), brute_pairs(rows))
    assert seen[2] < 2_000 and sum(seen) < 500 * simhash.BANDS


def test_rare_shingles_lose_no_pair(spark, copies):
    """Where all texts are apart and share one key, every pair of brute force meets, and few others."""
    marked, node_of = classes_of(spark.createDataFrame(copies, "doc_id long, text string"))
    nodes = marked.dropDuplicates(["node"]).select("node", "fp", F.lit(0).alias("band"), F.lit(0).alias("key"), F.col("node").alias("label"), F.lit(-1).cast("long").alias("head_label"), F.lit(9).alias("members"))
    none = spark.createDataFrame([], "a long, b long, similarity double")
    got = {(r.a, r.b) for r in simhash.similar_apart(nodes, none, marked.select("node", "text"), 0.8).collect()}
    want = {tuple(sorted((node_of[a], node_of[b]))) for a, b in brute_pairs(copies) if node_of[a] != node_of[b]}
    assert want <= got and len(got) < 4 * len(want)


def test_work_grows_with_the_texts(spark, monkeypatch):
    """Ten times as many versions of each text, most of them near duplicates of no other: no table of pairs holds many for each
    text, and no more texts meet on shingles than ten times as many, give or take a few."""
    own, took = simhash.saved, []
    for versions in (12, 120):
        rng, rows, left, held, pairs = random.Random(5), [], set(), Counter(), 0

        def saved(df, name, *a):
            nonlocal pairs
            out = own(df, name, *a)
            held[name] += (n := out.count())
            pairs = max(pairs, n if set(out.columns) == {"a", "b"} else 0)
            return out

        monkeypatch.setattr(simhash, "saved", saved)
        for f in range(10):
            base = [f"w{f}_{k}" for k in range(150)]
            some = [(1000 * f + i, " ".join(w if rng.random() > rate else f"y{rng.randrange(10**6)}" for w in base)) for i, rate in enumerate(rng.choices([0.01, 0.04, 0.05, 0.06], k=versions))]
            left |= roots([i for i, _ in some], brute_pairs(some))
            rows += some
        assert {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == left
        assert pairs <= 15 * len(rows) and held["compared"] <= 4 * len(rows)
        took.append(held["shingle-sets"])
    assert took[1] <= 15 * took[0]


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(w if k != i % 200 else f"y{i}" for k, w in enumerate(base))) for i in range(600)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, own = [], simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda pairs, texts: seen.append(pairs.count()) or own(pairs, texts))
    assert [r.doc_id for r in simhash.one_of_each_group(docs).collect()] == [0]
    assert sum(seen) <= simhash.BANDS * 600


def test_bits_between_similar_sets():
    """Pairs of similarity 0.8 and more stay far below the limit of differing bits."""
    rng = random.Random(8)
    worst = 0
    for _ in range(300):
        n = rng.choice([12, 40, 200, 1000])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for k in range(max(1, n // 50)):
            other[rng.randrange(n)] = f"x{k}"
        a, b = (np.unique(simhash.shingle_hashes(" ".join(w), 5)) for w in (words, other))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            worst = max(worst, ((simhash.bits_of(a) ^ simhash.bits_of(b)) & (1 << 64) - 1).bit_count())
    assert 0 < worst <= simhash.FAR


def test_odd_rows(spark):
    long_text = " ".join(f"v{k}" for k in range(5000))
    rows = [(1, None), (2, ""), (2, " "), (3, "a b c"), (4, "A  B c"), (4, "a b c"), (None, "x y z"), (None, "x y z"), (None, "a b c"), (7, long_text), (7, "other words here"), (8, long_text + " more"), (9, "a b"), (10, "same row"), (10, "same row")]
    clash = ("sign", "best", "node", "class", "least", "keys", "text_digest", "root", "id", "digest", "gone_id", "fp", "none", "whole_text")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in clash})
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    want = [(1, ""), (3, "a b c"), (None, "x y z"), (7, long_text), (7, "other words here"), (9, "a b"), (10, "same row")]
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter(want)
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_short_texts(spark):
    """A text of nine words and its first eight, of ten and nine, and so on: similarity 0.8 or more, by few shingles."""
    rng, rows, expected = random.Random(3), [], set()
    for k in range(3_000):
        n = rng.choice([9, 9, 10, 12, 20])
        words = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
        expected.add(2 * k)
    kept = simhash.one_of_each_group(spark.createDataFrame([(*r, None, None, 0) for r in rows], DOCS)).select("doc_id").collect()
    assert {r.doc_id for r in kept} == expected


def test_candidates_come_from_fingerprints_and_the_pivot_table(spark, monkeypatch):
    """Pairs of similarity 0.8 are found where blocks of their fingerprints are whole, and only if the pivot table lets them pass."""
    rng, rows = random.Random(4), []
    for k in range(60):
        words = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice([9, 90]))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - len(words) // 9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = brute_pairs(rows)
    assert len(pairs) == 60

    def blocks(text):
        own = np.unique(simhash.shingle_hashes(text, 5)).astype(np.uint64)
        bits = simhash.BITS if len(own) >= simhash.LARGE else simhash.FEW_BITS
        return {(b, i, (w >> 16 * i) & ((1 << bits) - 1)) for b, w in enumerate(simhash.words_of(own)) for i in range(simhash.BLOCKS)}

    texts = dict(rows)
    assert all(blocks(texts[a]) & blocks(texts[b]) for a, b in pairs)
    assert {r.doc_id for r in simhash.one_of_each_group(docs).collect()} == {2 * k for k in range(60)}
    own = simhash.pivot_table
    # Distances that no two texts of a pair could have: each row its own, far from all others' in one coordinate at least.
    monkeypatch.setattr(simhash, "pivot_table", lambda fps, n=simhash.PIVOTS: own(fps, n).withColumn("d0", F.xxhash64("fp")))
    assert len(simhash.one_of_each_group(docs).collect()) > 110
