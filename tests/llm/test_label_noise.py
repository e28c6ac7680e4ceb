"""The label model where some of the given labels are wrong."""

import random

from wareknit.llm import toxicity


def test_wrong_labels_are_outvoted(spark, monkeypatch):
    rng, rows, labels = random.Random(5), [], []
    rude, plain = [f"{a}{b}x" for a in ("grob", "lump", "wicht", "schuf") for b in ("e", "um", "ian")], [f"word{k}ing" for k in "abcdefghijklmnopqrst"]
    for k in range(1500):
        bad = k % 3 == 0
        words = [rng.choice(plain) for _ in range(30)] + (rng.sample(rude, 4) if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad != (rng.random() < 0.05))))
    seen, own = [], toxicity.label_model

    def watched(votes, start, *more):
        seen.append((votes, start, own(votes, start, *more)))
        return seen[-1][-1]

    monkeypatch.setattr(toxicity, "label_model", watched)
    toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    votes, start, posterior = seen[0]
    truth = votes[:, 0] == 1  # the first voter: any strong term
    wrong = truth != (start > 0.5)
    print("wrong labels", wrong.sum(), "corrected", ((posterior > 0.5) == truth)[wrong].sum())
    assert 30 < wrong.sum() < 100
    assert ((posterior > 0.5) == truth)[wrong].mean() > 0.9 and ((posterior > 0.5) == truth)[~wrong].mean() > 0.98
