"""Ranked lexical search against plain Python, on random, odd and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wareknit.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item string, score string", "item_id long, text string, rank string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    total, df = sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * len(own) // total
            score = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["The", "ÉTÉ", "été", "a1", "don't"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ", "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60)), "x", "y") for i in range(700)]
    docs += [(i, "equal text for ties the w1 w2 w3", None, None) for i in range(900, 930)] + [(905, "w7 w7 w7 a1", None, None)] * 3
    docs += [(None, "equal text for ties", None, None), (None, None, None, None), (950, "", None, None), (951, "!!!", None, None), (952, text(30_000), None, None)]
    items = [(i, text(rng.randint(1, 25)), "r") for i in range(30)] + [(100, None, None), (101, "...", None), (102, "notinany", None), (103, "equal ties", None), (104, "w7 a1", None), (104, "W9 w7", None), (None, "w3 w5", None), (105, "the " * 500, None)]
    return docs, items


@pytest.mark.parametrize("partitions,item_bytes", [(1, 8_000_000), (6, 8_000_000), (3, 6_000)])
def test_search_by_brute_force(spark, partitions, item_bytes, monkeypatch):
    docs, items = tables()
    df = spark.createDataFrame(docs, DOCS).repartition(partitions)
    got = lexical.search(df, spark.createDataFrame(items, ITEMS), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 10)


@pytest.mark.parametrize("seed", range(40))
def test_no_accumulator_is_missed(seed):
    """Small blocks with bounds that end the making of accumulators early, and a score known from other blocks."""
    rng = np.random.default_rng(seed)
    n, k = 60, 5
    row = {"ids": rng.permutation(n).tolist(), "sizes": rng.integers(1, 90, n).tolist(), "terms": np.arange(12), "starts": [0], "places": [], "times": []}
    for t in range(12):
        own = np.sort(rng.choice(n, rng.integers(1, 4 + 5 * t), replace=False))
        row["places"] += own.tolist()
        row["times"] += rng.integers(1, 5, len(own)).tolist()
        row["starts"].append(len(row["places"]))
    row = {c: np.array(v) if c not in ("ids", "sizes") else v for c, v in row.items()}
    p = lexical.Postings(row, {t: 6000 // (t + 1) for t in range(12)}, 1000, 40_000)
    scores = np.zeros(n, np.int64)
    for t in range(12):
        places, adds, _ = p.of(t)
        scores[places] += adds
    reached = int(rng.choice([0, np.sort(scores)[-3], np.sort(scores)[-20]]))
    want = sorted(((-s, i) for s, i in zip(scores.tolist(), row["ids"]) if s > 0 and s >= reached))[:k]
    assert [(-s, i) for s, i, _ in lexical.best_in_block(p, list(range(12)), k, reached)] == want


def test_few_accumulators_are_made():
    """Frequent terms make no new ones once the rare terms' documents are ahead."""
    n = 5_000
    row = {"ids": list(range(n)), "sizes": [100] * n, "terms": np.arange(2), "starts": np.array([0, 20, 20 + n]), "places": np.array([*range(20), *range(n)]), "times": np.ones(20 + n, np.int64)}
    p = lexical.Postings(row, {0: 5000, 1: 10}, n, 100 * n)
    made = []
    real = np.partition
    np.partition = lambda a, at: made.append(int((a > 0).sum())) or real(a, at)
    try:
        best = lexical.best_in_block(p, [0, 1], 10, 0)
    finally:
        np.partition = real
    assert made == [20] and [i for _, i, _ in best] == list(range(10))


def test_empty_tables(spark):
    docs, items = tables()
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
