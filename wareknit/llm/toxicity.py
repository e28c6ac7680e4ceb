"""Toxicity by weak supervision.

Terms (words, and word beginnings of four to six letters) whose document frequency differs most between labelled toxic
and clean rows make the lexicons. Many voters look at a text: one for each strong term, lexicon counts at several
levels, and patterns of letter case, punctuation and masked letters. A generative label model (expectation
maximisation over the hidden label) estimates each voter's behaviour under either label and the correlations of the
voters' votes, so that voters that say the same thing twice don't count twice, and gives each sampled row a posterior
label. The given labels choose the terms and start the estimation, but don't vote, so that a wrong one can be outvoted.
A logistic classifier over the lexicon terms and votes is trained on the posterior labels, and scores texts.

The model is fitted on a bounded sample of the labelled rows that may be learned from: at most SAMPLE different texts of
each label, of the ids with the smallest hash. Terms are counted by Spark over that sample, and at most TERMS of them and
the sample's votes come to the driver.

Edge cases: a null text is an empty one, which has a score too; without labelled rows, or with rows of one label only,
every score is the share of that label (0 without any); labels other than 0 and 1 are left out; rows labelled twice
count as toxic if one label says so; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, whole_text
from .memo import Memo

SAMPLE = 10_000
TERMS = 300
VOTING_TERMS = 40
LETTERS = re.compile(r"[^\W\d_]+").findall
#: What the pattern voters look for; each votes toxic where it is found. Expressions start with a class
#: of few characters, so that ordinary text is passed over quickly.
SHOUTING = re.compile("[A-ZÀ-ÖØ-Þ]{4,}\\s+[A-ZÀ-ÖØ-Þ]{4,}").search
MARKS = re.compile("[!?]{3,}").search
MASKED = re.compile("[*#@$%]{2,}\\w").search
HELD_TERMS = 400_000


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)]


def text_terms(text: str) -> set[str]:
    return {t for w in set(LETTERS(text.lower())) for t in terms_of(w)}


def learnable(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def least(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key and toxic of at most size rows of each label, those with the smallest hash of key."""
    both = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(size) for k in (0, 1)]
    return both[0].unionByName(both[1])


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic of the labelled rows to learn from: at most size different texts of each label."""
    marks = labels.filter(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # 2 * size ids or digests, and labels, at most: the bound of either broadcast.
    rows = docs.select("doc_id", whole_text("text").alias("text")).join(F.broadcast(least(marks, "doc_id", size)), "doc_id")
    rows = saved(rows.select(F.sha2("text", 256).alias("digest"), "text", "toxic"), "labelled-rows")
    # Ids may be repeated, and texts be copies: each text counts once for a label, and so many at most.
    chosen = least(rows.select("digest", "toxic").distinct(), "digest", size)
    return rows.join(F.broadcast(chosen), ["digest", "toxic"]).dropDuplicates(["digest", "toxic"]).select("text", "toxic")


def term_counts(rows: DataFrame) -> DataFrame:
    """term, n0, n1: documents of either label with the term."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def taken() -> pa.RecordBatch:
            terms = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in sums)], ["term", "n0", "n1"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                own = sums[toxic.as_py()]
                own.update(text_terms(text.as_py()))
                own[""] += 1
                if len(sums[0]) + len(sums[1]) > HELD_TERMS:
                    yield taken()
                    sums[0].clear()
                    sums[1].clear()
        yield taken()

    return rows.mapInArrow(partial, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Voters:
    """Votes of -1 (clean), 0 and 1 (toxic), and the lexicon terms of a text."""

    def __init__(self, terms: list[str], strong: int):
        self.index = {t: i for i, t in enumerate(terms)}
        self.strong = strong  # the first terms speak for toxic texts, the strongest first
        self.memo = Memo(lambda w: tuple(self.index[t] for t in terms_of(w) if t in self.index))

    def look(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the terms found, and the votes."""
        words, hits, times = Counter(LETTERS(text.lower())), set(), 0
        for k, own in zip(words.values(), self.memo.all(list(words))):
            if own:
                hits.update(own)
                times += k * (min(own) < self.strong)
        found = np.array(sorted(hits), dtype=np.int32)
        n = sum(1 for h in hits if h < self.strong)
        levels = [1 if n >= k else -1 for k in (1, 2, 3, 5)] + [1 if times >= k else -1 for k in (2, 4)]
        patterns = [SHOUTING(text) is not None, MARKS(text) is not None, MASKED(text) is not None]
        votes = np.zeros(len(levels) + len(patterns) + min(self.strong, VOTING_TERMS), np.int8)
        votes[: len(levels) + len(patterns)] = [*levels, *patterns]
        for h in hits:
            if h < min(self.strong, VOTING_TERMS):
                votes[len(levels) + len(patterns) + h] = 1
        return found, votes


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25, ridge: float = 0.1) -> np.ndarray:
    """Posterior label of each row.

    Given the label, votes have a mean for each voter (its accuracy) and a covariance common to both labels (the
    voters' correlations); both and the label's share are estimated anew from the posteriors in each round. Which
    hidden label is found depends on the start: the operator starts from the given labels.
    """
    v, q = votes.astype(np.float64), start.astype(np.float64)
    for _ in range(rounds):
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        m1, m0 = (q @ v) / max(q.sum(), 1e-9), ((1 - q) @ v) / max((1 - q).sum(), 1e-9)
        c1, c0 = v - m1, v - m0
        cov = ((c1 * q[:, None]).T @ c1 + (c0 * (1 - q)[:, None]).T @ c0) / len(v) + ridge * np.eye(v.shape[1])
        w = np.linalg.solve(cov, m1 - m0)
        z = v @ w - (m1 + m0) @ w / 2 + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, falling: np.ndarray | None = None, rounds: int = 800, ridge: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model of soft labels (accelerated projected gradient steps).

    falling: for each column, whether its weight may not be positive; otherwise it may not be negative, so that what
    votes toxic never makes a text look cleaner. None: weights are free.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    top = np.ones(x.shape[1], x.dtype)
    for _ in range(30):  # the largest curvature bounds the step
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    step = 3.5 * len(x) / float(np.linalg.norm(x @ top) ** 2)
    w = last = look = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        g = x.T @ (p - q) / len(x) + ridge * np.append(look[:-1], 0)
        w = look - step * g.astype(x.dtype)
        if falling is not None:
            w[:-1] = np.where(falling, np.minimum(w[:-1], 0), np.maximum(w[:-1], 0))
        look = w + k / (k + 3) * (w - last)
        last = w
    return w


class Model:
    def __init__(self, terms: list[str], strong: int, weights: list[float] | None, constant: float = 0.0):
        self.terms, self.strong, self.weights, self.constant = terms, strong, weights, constant


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    rows = saved(sampled(docs, labels, size), "labelled-sample")
    counts = saved(term_counts(rows), "term-counts")
    whole = counts.filter("term = ''").head()
    n0, n1 = (whole["n0"], whole["n1"]) if whole else (0, 0)
    if not n0 or not n1:
        return Model([], 0, None, 1.0 if n1 else 0.0)
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1))
    counts = counts.filter("term <> ''").withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    # A term speaks for toxic texts if it is twenty times as frequent there, and in one of a hundred of them or more.
    strong = counts.filter((F.col("n1") >= max(3, 0.01 * n1)) & (F.col("odds") > 3)).orderBy(F.desc("z"), "term").limit(TERMS // 2).collect()
    weak = counts.filter((F.col("n0") >= max(3, 0.01 * n0)) & (F.col("odds") <= 0.5)).orderBy("z", "term").limit(TERMS // 2).collect()
    terms = [r["term"] for r in [*strong, *weak]]
    found, votes, toxic = votes_of(rows, terms, len(strong))
    # The given labels are the start only: as a voter they would be their own proof, and outvote all others.
    posterior = label_model(votes, toxic)
    x = features(found, votes, len(terms))
    falling = (np.arange(x.shape[1]) >= len(strong)) & (np.arange(x.shape[1]) < len(terms))
    return Model(terms, len(strong), fit_linear(x, posterior.astype(np.float32), falling).tolist())


def features(found: list[np.ndarray], votes: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(found), n + votes.shape[1]), np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1
    x[:, n:] = votes
    return x


def votes_of(rows: DataFrame, terms: list[str], strong: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sample's terms, votes and labels; bounded by the sample."""

    @F.arrow_udf("struct<found: binary, votes: binary>")
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = Voters(terms, strong)
        for batch in batches:
            seen_ = [v.look(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x in column], pa.binary()) for column in ([f for f, _ in seen_], [v_ for _, v_ in seen_])], ["found", "votes"])

    got = rows.select(seen("text").alias("s"), "toxic").select("s.found", "s.votes", "toxic").toArrow()
    # In an order of their own, so that sums don't depend on how rows came.
    got = sorted(zip(got["toxic"].to_pylist(), got["found"].to_pylist(), got["votes"].to_pylist()))
    found = [np.frombuffer(f, np.int32) for _, f, _ in got]
    return found, np.array([np.frombuffer(v, np.int8) for _, _, v in got]), np.array([t for t, _, _ in got], dtype=np.float64)


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1."""
    if model.weights is None:
        return F.when(text.isNull(), F.lit(model.constant)).otherwise(F.lit(model.constant))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v, w, n = Voters(model.terms, model.strong), np.array(model.weights), len(model.terms)
        for (batch,) in slices((b,) for b in batches):
            out = []
            for t in batch:
                found, votes = v.look(t.as_py() or "")
                z = min(30.0, max(-30.0, float(w[found].sum() + votes @ w[n:-1] + w[-1])))
                out.append(1 / (1 + math.exp(-z)))
            yield pa.array(out, pa.float64())

    return score(text)
