"""Offers and rules: checked rule tables, decisions by brute force, and how often patterns are compiled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wareknit.functions import scores
from wareknit.operators import offers
from wareknit.plans import inputs

RULES = "product string, plus_words string, minus_words string, regex string"
OFFERS = "offer_id long, product string, row_text string, rule string, row string, __extra string"


def found(pattern, text):
    return re.search("(?i)" + pattern, text) is not None


def brute(text, plus, minus, regex):
    plus, minus = (re.sub(r"^\||\|$", "", x or "") for x in (plus, minus))
    checks = [not minus or not found(minus, text), not plus or all(found(w, text) for w in plus.split("|")), not regex or re.match("(?i)(?:" + regex + ")", text) is not None]
    return "".join("1" if c else "0" for c in checks)


def tables(rng):
    words = ["red", "cup", "jar", "ol", "b.g", r"\bcup\b", "^red", "jar$", "re[ds]", "(?:red)", "", r"(c)u\1?p", "(?s:red.cup)", "x{2}"]
    listed = lambda: rng.choice([None, "", "|".join(rng.choice(words) for _ in range(rng.randint(1, 3)))])
    rules = [(f"p{k}", listed(), rng.choice([None, "", "old", "|old|", "big|xx"]), rng.choice([None, "", "red", ".*cup", "(?=.*(red))(?=.*(cup))"])) for k in range(40)]
    texts = [" ".join(rng.choice(["red", "cup", "jar", "old", "big", "Red", "xx", "cups", "red\ncup"]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = [(i, f"p{rng.randint(0, 44)}", rng.choice([*texts, None]), "r", "x", "kept") for i in range(900)]
    return rules, rows


def test_decisions_by_brute_force(spark):
    rules, rows = tables(random.Random(8))
    catalog, df = spark.createDataFrame(rules + rules[:2], RULES), spark.createDataFrame(rows, OFFERS)
    of = {r[0]: r[1:] for r in rules}
    want = sorted((i, brute(t or "", *of.get(p, ("", "", "")))) for i, p, t, *_ in rows for _ in range(2 if p in ("p0", "p1") else 1))
    for validate in (offers.validate_offers, offers.validate_each):
        got = validate(df, catalog)
        assert got.columns == [*df.columns, "reason", "validation_mark"]
        out = got.collect()
        assert sorted((r.offer_id, r.reason) for r in out) == want and all(r.validation_mark == (r.reason == "111") and r["__extra"] == "kept" for r in out)
    assert len({r for _, r in want}) >= 6
    assert offers.validate_offers(df.limit(0), catalog).count() == 0 and offers.validate_offers(df, catalog.limit(0)).filter("reason = '111'").count() == len(rows)


@pytest.mark.parametrize("column,words,digit", [("minus_words", "old|(big", 0), ("plus_words", "red|(big", 1), ("regex", "(?=.*(red", 2)])
def test_one_bad_rule(spark, column, words, digit):
    """A pattern that doesn't compile is set aside; offers under other rules are decided as before."""
    good = [{"product": f"p{k}", "plus_words": "red", "minus_words": "old", "regex": ".*cup"} for k in range(3)]
    rows = [(i, f"p{i % 4}", ["red cup", "red jar", "old red cup"][i % 3], None, None, "x") for i in range(48)]
    df = spark.createDataFrame(rows, OFFERS)
    bad = good[0] | {"product": "p3", column: words}
    catalog = lambda rs: spark.createDataFrame([tuple(r[c] for c in ("product", "plus_words", "minus_words", "regex")) for r in rs], RULES)
    before = {r.offer_id: (r.reason, r.validation_mark) for r in offers.validate_offers(df, catalog([*good, good[0] | {"product": "p3"}])).collect()}
    for validate in (offers.validate_offers, offers.validate_each):
        for r in validate(df, catalog([*good, bad])).collect():
            reason, mark = before[r.offer_id]
            if r.product == "p3":
                reason = reason[:digit] + "e" + reason[digit + 1 :]
                mark = 0 if "0" in reason else None
            assert (r.reason, r.validation_mark) == (reason, mark)
    aside = offers.check_rules(catalog([*good, bad])).bad.collect()
    assert [r.list for r in aside] == [column.removesuffix("_words")] and aside[0].words == words
    scored = {r.offer_id: r.validation_mark for r in offers.score_offers(df, catalog([*good, bad])).collect()}
    plain = {r.offer_id: r.validation_mark for r in offers.score_offers(df, catalog([*good, good[0] | {"product": "p3"}])).collect()}
    assert all(scored[i] == (None if i % 4 == 3 and column != "regex" else scored[i] if i % 4 == 3 else plain[i]) for i in plain)
    fuzzy = offers.score_offers(df, catalog([*good, bad]), fuzzy=frozenset({"plus", "minus"})).filter("product = 'p3'")
    assert fuzzy.filter("validation_mark is null").count() == 0


def test_each_distinct_pattern_is_compiled_once(spark):
    catalog = spark.createDataFrame([(f"p{k}", "red|cup", "old", "x") for k in range(500)], RULES)
    checked = offers.check_rules(catalog)
    assert checked.rules.count() == 1 and checked.bad.count() == 0
    plan = offers.check_rules(spark.createDataFrame([("p", "(big", None, None), ("q", "(big", "a", None)], RULES)).bad
    assert [tuple(r) for r in plan.orderBy("words").collect()] == [("plus", "(big", "(big")]


def test_rules_lie_together(spark, sf_dir):
    """Inside a partition each rule comes once, so that its patterns are compiled once there: runs of equal patterns are counted."""
    runs = []

    def decide(pairs):
        def count(batches):
            last, n, rows = None, 0, 0
            for b in batches:
                for rule in b["rule"]:
                    n, last, rows = n + (rule != last), rule, rows + 1
            import pandas as pd

            yield pd.DataFrame({"n": [n], "rows": [rows]})

        runs.extend(pairs.select("rule").mapInPandas(count, "n long, rows long").collect())
        return pairs.select("row", "rule", offers.reason_of("row").alias("reason"))

    df, catalog = inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir)
    checked = offers.check_rules(catalog)
    offers.decided(df, catalog, checked, "row_text", "product", "product", decide)
    rules, rows = checked.rules.count(), sum(r.rows for r in runs)
    assert rows == df.join(catalog, "product").select("row_text", "product").distinct().count()
    assert sum(r.n for r in runs) <= rules * len(runs) and sum(r.n for r in runs) < rows / 2


def test_a_rule_with_half_of_the_offers(spark):
    rules = spark.createDataFrame([(f"p{k}", f"w{k}", None, None) for k in range(20)], RULES)
    rows = [(i, "p0" if i % 2 else f"p{i % 20}", f"w0 {i}", None, None, None) for i in range(8_000)]
    df = spark.createDataFrame(rows, OFFERS)
    got = offers.validate_offers(df, rules)
    assert got.filter("product = 'p0' and reason = '111'").count() == sum(r[1] == "p0" for r in rows)


def brute_score(text, plus, minus, regex, fuzzy):
    plus, minus = ([w for w in x.split("|")] if x else [] for x in (plus, minus))
    bodies = re.findall(r"\(\?=\.\*.*?\)\)+", regex)
    share = lambda w: round(scores.best_substring(w, text)) / 100
    hits = sum(share(w) if "plus" in fuzzy else found(w, text) for w in plus)
    hits += sum(1 - share(w) if "minus" in fuzzy else not found(w, text) for w in minus) + sum(found(b, text) for b in bodies)
    total = len(plus) + len(minus) + len(bodies)
    return hits / total if total else 0.0


@pytest.mark.parametrize("fuzzy", [(), ("plus",), ("plus", "minus")])
def test_score_query_by_brute_force(spark, sf_dir, fuzzy):
    """r7's rows on the smallest tables, and the other modes on the same offers."""
    df, catalog = inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir)
    of = {r["product"]: (r.plus_words, r.minus_words, r.regex) for r in catalog.collect()}
    got = offers.score_offers(df, catalog, fuzzy=frozenset(fuzzy)).collect()
    assert len(got) == df.count()
    want = {(r["product"], r.row_text): brute_score(r.row_text, *of[r["product"]], fuzzy) for r in got}
    assert all(abs(r.validation_mark - want[r["product"], r.row_text]) < 1e-9 for r in got)
    if fuzzy == ("plus",):
        import __spark_entry__ as entry

        texts = {tuple(r[k] for k in inputs.PAIR_KEYS): (r["product"], r.row_text) for r in df.collect()}
        rows = entry.queries()["r7_fuzzy_score"](spark, sf_dir).collect()
        assert len(rows) == len(got) and all(abs(r.validation_mark - want[texts[tuple(r[k] for k in inputs.PAIR_KEYS)]]) < 1e-6 for r in rows)


def test_scores_without_rules(spark):
    df = spark.createDataFrame([(1, "none", "red", None, None, None), (2, "empty", None, None, None, None)], OFFERS)
    rules = spark.createDataFrame([("empty", None, "", None)], RULES)
    assert [r.validation_mark for r in offers.score_offers(df, rules, strict=frozenset({"plus"})).collect()] == [0.0, 0.0]
    assert offers.score_offers(df, rules).filter(F.col("__extra").isNull()).count() == 2
