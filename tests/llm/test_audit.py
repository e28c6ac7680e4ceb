"""The filter audit against plain Python: every document through every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from wareknit.llm import audit

DOCS, LABELS = "doc_id long, text string, source string, part string, id string", "doc_id long, quality int, toxic int, n int"


def fails(text, i, ids):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if i is not None and any(j < i for j in ids) else "")


def brute(docs, labels):
    same = defaultdict(list)
    for i, t, *_ in docs:
        same[t or ""] += [i] if i is not None else []
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = [(s or "", i, fails(t or "", i, same[t or ""])) for i, t, s, *_ in docs]
    out = []
    for part in {s for s, *_ in rows}:
        own = [(i, f) for s, i, f in rows if s == part]
        taken, shapley = {}, Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(removed)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                taken["".join(order), k + 1] = (len(left), len(removed), redundant, sum(x[1] == f for x in own), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed))
        out += [(part, o, k, *v, shapley[o[k - 1]]) for (o, k), v in taken.items()]
    return sorted(out)


def tables():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "The", "of", "OF", "a", "é", "Éa", "x#", "b|c"] + [f"w{k}" for k in range(40)])
    text = lambda: rng.choice([" ", "\n", "\x0b"]).join((word() if rng.random() < 0.5 else f"u{rng.random()}") for _ in range(rng.choice([3, 49, 50, 51, 80])))
    texts = [text() for _ in range(150)] + [None, "", "", " \x1f ", "A" * 50, "a" * 19 + "A", "a" * 20 + "A", "word " * 30_000 + "end "]
    docs = [(rng.randint(0, 400), rng.choice(texts), rng.choice(["s1", "s2", "", None, "S1"]), "clash", None) for _ in range(500)]
    docs += [(None, texts[0], "s1", None, None)] * 3 + [docs[0]] * 4 + [(1000, "\x85word\xa0word " + "z " * 60, "only", None, None)]
    labels = [(rng.choice([None, rng.randint(0, 400)]), rng.choice([0, 1, None, 2]), rng.choice([0, 1, None]), 1) for _ in range(300)]
    return docs, labels


@pytest.mark.parametrize("partitions,shard_rows", [(1, 10_000), (5, 7)])
def test_audit_by_brute_force(spark, partitions, shard_rows):
    docs, labels = tables()
    got = audit.audit(spark.createDataFrame(docs, DOCS).repartition(partitions), spark.createDataFrame(labels, LABELS), shard_rows=shard_rows)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = sorted(map(tuple, got.collect()))
    assert found == brute(docs, labels)


def test_the_dictionary_and_the_matrix(spark):
    """Words have numbers without gaps, and a word the same number in every shard."""
    texts = [f"a b w{i % 30} w{i} b" for i in range(200)]
    docs = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "id long, part string, text string").repartition(7)
    local = audit.local_shards(docs)
    every = local.select("shard", audit.F.posexplode("words").alias("at", "word"))
    words = {(r.shard, r.at): r.number for r in audit.dictionary(every, every.count()).collect()}
    named = {(bytes(r.word), words[r.shard, r.at]) for r in every.collect()}
    assert sorted(n for _, n in named) == list(range(len({w for t in texts for w in t.split()}))) and len({w for w, _ in named}) == len(named)
    seen = defaultdict(set)
    for s in audit.csr_shards(docs, shard_rows=9).collect():
        starts, columns, times = audit.matrix_of(s.starts, s.columns, s.times, np.array(s.own))
        for r, i in enumerate(s.ids):
            own = dict(zip(columns[starts[r] : starts[r + 1]].tolist(), times[starts[r] : starts[r + 1]].tolist()))
            want = Counter(texts[i].split())
            assert sorted(own.values()) == sorted(want.values()) and len(own) == len(want)
            for c in own:
                seen[c].add(frozenset(want))
    assert all(frozenset.intersection(*docs_) for docs_ in seen.values()) and len(seen) == len(named)


def test_empty_tables(spark):
    docs, labels = tables()
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).head()[0] == 0
