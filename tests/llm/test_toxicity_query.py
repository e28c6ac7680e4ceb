"""op10's rows on small tables, with the choice of terms, the label model and the fit restated."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from wareknit.llm import toxicity
from wareknit.llm.queries import QUERIES


def terms_of(text):
    words = set("".join(c if c.isalpha() else " " for c in text.lower()).split())
    return words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) > k}


def chosen_terms(rows):
    """Terms twenty times as frequent in toxic texts, and those of clean ones, by their log odds over the deviation."""
    counts = {t: Counter(x for text, toxic in rows if toxic == t for x in terms_of(text)) for t in (0, 1)}
    n0, n1 = (sum(toxic == t for _, toxic in rows) for t in (0, 1))
    found = []
    for t in counts[0].keys() | counts[1].keys():
        a, b = counts[1][t] + 0.5, counts[0][t] + 0.5
        odds = math.log(a / (n1 + 1)) - math.log(b / (n0 + 1))
        found.append((odds / math.sqrt(1 / a + 1 / b), t, odds))
    strong = sorted((-z, t) for z, t, odds in found if counts[1][t] >= max(3, 0.01 * n1) and odds > 3)[:150]
    weak = sorted((z, t) for z, t, odds in found if counts[0][t] >= max(3, 0.01 * n0) and odds <= 0.5)[:150]
    return [t for _, t in strong], [t for _, t in weak]


def seen(text, strong, weak):
    """Which terms a text has, and the votes."""
    has = terms_of(text)
    words = Counter("".join(c if c.isalpha() else " " for c in text.lower()).split())
    n = sum(t in has for t in strong)
    times = sum(k for w, k in words.items() if terms_of(w) & set(strong))
    votes = [1 if n >= k else -1 for k in (1, 2, 3, 5)] + [1 if times >= k else -1 for k in (2, 4)]
    votes += [int(re.search(p, text) is not None) for p in (r"[A-ZÀ-ÖØ-Þ]{4,}\s+[A-ZÀ-ÖØ-Þ]{4,}", "[!?]{3,}", r"[*#@$%]{2,}\w")]
    return [int(t in has) for t in [*strong, *weak]], votes + [int(t in has) for t in strong[:40]]


def posteriors(votes, labels):
    """Two normal distributions with one covariance, estimated in turns with the rows' shares in them."""
    v, q = np.array(votes, float), np.array(labels, float)
    for _ in range(25):
        share = min(max(q.mean(), 1e-3), 1 - 1e-3)
        means = [np.average(v, axis=0, weights=w) for w in (1 - q, q)]
        cov = sum(np.einsum("n,ni,nj->ij", w, v - m, v - m) for w, m in zip((1 - q, q), means)) / len(v) + 0.1 * np.eye(v.shape[1])
        inverse = np.linalg.inv(cov)
        far = [np.einsum("ni,ij,nj->n", v - m, inverse, v - m) / 2 for m in means]
        z = far[0] - far[1] + math.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done, q = np.abs(new - q).max() < 1e-6, new
        if done:
            break
    return q


def loss(w, x, q):
    z = x @ w
    return np.mean(np.logaddexp(0, z) - q * z) + 0.5e-5 * (w[:-1] ** 2).sum()


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic in (0, 1)").collect()}
    rows = sorted({(docs[i], t) for i, t in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 5})
    strong, weak = chosen_terms(rows)
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert (model.terms, model.strong) == ([*strong, *weak], len(strong)) and strong
    looks = [seen(t, strong, weak) for t, _ in rows]
    x = np.array([[*has, *votes, 1] for has, votes in looks], float)
    q = posteriors([v for _, v in looks], [t for _, t in rows])
    w = np.array(model.weights)
    falling = np.array([len(strong) <= k < len(strong) + len(weak) for k in range(x.shape[1] - 1)])
    assert (w[:-1][falling] <= 0).all() and (w[:-1][~falling] >= 0).all()
    # The fit is near the best: plain steps from there gain next to nothing.
    best, step = w.copy(), 4 / np.linalg.norm(x, 2) ** 2 * len(x)
    for _ in range(3_000):
        g = x.T @ (1 / (1 + np.exp(-x @ best)) - q) / len(x) + 1e-5 * np.append(best[:-1], 0)
        best -= step * g
        best[:-1] = np.where(falling, np.minimum(best[:-1], 0), np.maximum(best[:-1], 0))
    assert loss(best, x, q) <= loss(w, x, q) + 1e-9 and loss(w, x, q) - loss(best, x, q) < 2e-3
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        has, votes = seen(text, strong, weak)
        score = 1 / (1 + math.exp(-min(30, max(-30, float(np.dot([*has, *votes, 1], w))))))
        assert abs(got[i].score - score) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.5)
