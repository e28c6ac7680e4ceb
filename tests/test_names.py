"""Measures, features, similarity, cross words and offers on labelled and brute-force fixtures."""

import itertools
import json
import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import pairs as P
from pyspark.sql import functions as F

from wareknit.functions import scores
from wareknit.functions import words as W
from wareknit.operators import cross, features, measures, offers, similarity
from wareknit.plans.rules import SimilarityRules, load_measure_rules, load_similarity_rules, shipped_rules
from wareknit.sources.tables import read_products, write_result

RULES = shipped_rules()
OVERALL = RULES.merged("overall")
PAIRS = "pair_id long, client string, source string, is_equal boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAIRS)


def wrong_features(spark, rows):
    df = features.validate_features(frame(spark, rows), "client", "source", RULES)
    return df.filter((F.col("features validation") == 1) != F.col("is_equal")).select("client", "source", "is_equal").collect()


@pytest.mark.parametrize("kind", [*P.HAND, "complex"])
def test_feature_hand_pairs(spark, kind):
    assert wrong_features(spark, P.COMPLEX if kind == "complex" else P.HAND[kind]) == []


@pytest.mark.parametrize("kind", [*P.NUMERIC, "colour"])
def test_feature_generated_pairs(spark, kind):
    rows = P.colour_pairs() if kind == "colour" else P.numeric_pairs(kind)
    assert wrong_features(spark, rows) == []


@pytest.mark.parametrize("kind", [*P.NUMERIC, *P.HAND, "colour"])
def test_generated_regex(spark, kind):
    rows = P.colour_pairs() if kind == "colour" else [*(P.numeric_pairs(kind) if kind in P.NUMERIC else []), *P.HAND.get(kind, [])]
    df = measures.extract_measures(frame(spark, rows), "client", OVERALL)
    bad = measures.match_regex(df, "source", "Regex").filter("matched <> is_equal").select("client", "source", "Regex").collect()
    assert bad == []


def test_no_regex_for_other_measures(spark):
    names = sorted({a for kind in P.NUMERIC for a, _, _ in P.numeric_pairs(kind)})
    kinds = {a: kind for kind in P.NUMERIC for a, _, _ in P.numeric_pairs(kind)}
    own = {"weight": "Вес", "volume": "Объем", "memory": "Объем памяти", "length": "Длина"}
    df = spark.createDataFrame([(n, kinds[n]) for n in names], "name string, kind string")
    for kind, measure in own.items():
        m = next(m for m in RULES.measures if m.name == measure)
        made = measures.extract_measure(df, "name", m, "rx").filter((F.col("kind") != kind) & (F.col("rx") != "")).collect()
        assert made == [], measure


def test_shipped_patterns_compile_in_java(spark):
    for m in RULES.measures:
        for u in m.units:
            spark.range(1).select(F.lit("x").rlike(measures.ANY_CASE + u.search)).collect()


def test_features_are_symmetric_and_null_safe(spark):
    rows = [("a 1 кг", None), (None, None), ("", ""), ("Плитка 10х10х10", "Плитка 10х10"), ("9" * 30 + " кг", "1 кг")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pair_id long, client string, source string")
    one = {r.pair_id: r["features validation"] for r in features.validate_features(df, "client", "source", RULES).collect()}
    other = {r.pair_id: r["features validation"] for r in features.validate_features(df, "source", "client", RULES).collect()}
    assert one == other == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_compare_modes(spark):
    df = spark.createDataFrame([(["1"], ["1", "2"]), (["1", "2"], ["1"]), (["3"], ["1"]), ([], [])], "c array<string>, s array<string>")
    got = df.select(*[features.compare_sets(F.col("c"), F.col("s"), m).alias(m) for m in ("strict", "modest", "client", "source")]).collect()
    assert [tuple(r) for r in got[:3]] == [(False, True, True, False), (False, True, False, True), (False, False, False, False)]
    assert [r[0] for r in df.select(features.not_found(F.col("c"), F.col("s"), "modest")).collect()] == [None, None, None, True]


def test_sizes_and_bodies(spark):
    df = spark.createDataFrame([("box 10x20x5 ",), ("tile 15x3 ",), ("none 7",), (None,)], "name string")
    got = [r.Sizes for r in measures.extract_sizes(df, "name").collect()]
    assert got[0] == r"(?=.*(\D1\D+2\D+0.5\D|\D10\D+20\D+5\D|\D100\D+200\D+50\D))"
    assert got[1] == r"(?=.*(\D1.5\D+0.3\D|\D15\D+3\D|\D150\D+30\D))" and got[2:] == ["", ""]
    rx = spark.createDataFrame([("(?=.*(a|b))(?=.*(c(?:d)))", "xAy cD")], "rx string, name string")
    assert rx.select(measures.parse_regex("rx")).head()[0] == ["a|b", "c(?:d)"]
    assert measures.strip_by_regex(rx, "name", "rx").head()["name"] == "xy  "


def test_rules_from_json():
    unit = {"unit_name": "Gram", "symbol": "g", "relative_weight": 1, "prefix": "common", "postfix": "", "max_count": "common", "search_mode": "behind", "use_it": True}
    data = {"common_prefix": "[^0-9]", "common_postfix": "", "common_max_count": 2, "special_value_search": None, "units": [unit, unit | {"unit_name": "Off", "use_it": False}]}
    measure = {"measure_name": "Weight", "SemantiX": {"merge_mode": "1", "exclude_rx": False, "use_it": True}, "FeatureFlow": {"use_it": False, "validation_mode": "strict", "not_found_mode": "strict", "priority": 3}, "measure_data": data}
    rules = load_measure_rules(json.dumps({"numeric_measures": {"use_it": True, "measures": [measure]}, "string_measures": {"use_it": False, "measures": [measure]}}))
    assert [u.name for u in rules.measures[0].units] == ["Gram"] and rules.measures[0].units[0].max_count == 2
    assert rules.measures[0].units[0].search == r"[^0-9]\d*[.,]?\d+\s*(?:g)" and rules.for_features() == [] and len(rules.for_regexes()) == 1
    with pytest.raises(ValueError):
        load_measure_rules(json.dumps({"numeric_measures": {"measures": [measure | {"FeatureFlow": {"validation_mode": "odd"}}]}}))


def test_words(spark):
    df = spark.createDataFrame([("Foo BAR 12 abcд x-ray Ёлка ёлка 10мг",), (None,)], "t string")
    one = lambda c: df.select(c).head()[0]
    assert one(W.extract_words("t", W.WordRule("english"))) == ["Foo", "BAR", "x", "ray"]
    assert one(W.extract_words("t", W.WordRule("russian", case="capital"))) == ["Ёлка"]
    assert one(W.extract_words("t", W.WordRule("english", case="caps", with_numbers=True, check_letters=True))) == ["BAR"]
    assert one(W.extract_words("t", W.WordRule("english", symbols="-"))) == ["Foo", "BAR", "x-ray"]
    assert one(W.delete_words("t", W.WordRule("english", case="caps"))) == "Foo 12 abcд x-ray Ёлка ёлка 10мг"
    assert one(W.extract_words_multi("t", [W.WordRule("russian", min_length=2), W.WordRule("english")])) == ["Foo", "BAR", "ray", "Ёлка", "ёлка"]
    assert one(W.join_words(W.filter_words(W.extract_words("t", W.WordRule("english")), 2, 2))) == "Foo|BAR"
    assert one(W.simple_tokens("t")) == sorted(["foo", "bar", "12", "abcд", "x-ray", "лка", "10мг"])
    assert df.select(W.simple_tokens("t")).collect()[1][0] == []


def test_stems():
    english = {"consigned": "consign", "consisting": "consist", "knightly": "knight", "kneeling": "kneel", "happy": "happi", "flies": "fli", "relational": "relat", "generously": "generous", "skis": "ski", "national": "nation", "hopping": "hop", "hoping": "hope"}
    assert {w: scores.stem_english(w) for w in english} == english
    russian = {"важная": "важн", "вавиловка": "вавиловк", "валяется": "валя", "падает": "пада", "противоестественном": "противоестествен", "красный": "красн", "бегавшая": "бега"}
    assert {w: scores.stem_russian(w) for w in russian} == russian


def test_token_scores():
    assert scores.token_score("abc", "abc") == 100 and scores.token_score("abc", "xyz") == 0
    assert scores.token_score("красный", "красная") == 71 and scores.token_score("cat", "cats-dog") == 90

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "ab")
        assert scores.common_length(a, b) == slow(a, b)


def test_similarity_agreement(spark):
    df = frame(spark, P.similarity_pairs())
    got = similarity.validate_similarity(df, "client", "source", load_similarity_rules())
    assert got.filter((F.col("fuzzy validation") == 1) == F.col("is_equal")).count() / df.count() > 0.97


def test_marks_and_alignment(spark):
    rules = SimilarityRules(min_appearance=0)
    df = frame(spark, [("Red Apple", "red apple", True), ("Red Aple", "red apple big", True), ("x1", "", False), (None, None, True)])
    got = {r.pair_id: r for r in similarity.validate_similarity(df, "client", "source", rules).collect()}
    assert got[0].union_mark == 1 and got[1].client_mark == 1 and 0 < got[1].union_mark < 1 and got[2].union_mark == 0 == got[3].union_mark
    assert similarity.validate_similarity(df.limit(0), "client", "source", rules).count() == 0
    with pytest.raises(ValueError):
        similarity.validate_similarity(df, "client", "source", rules, 1.5)
    assert spark.createDataFrame([("a'b|\"c/d\"",)], "t string").select(similarity.clean_names("t")).head()[0] == 'abcd"'


@pytest.mark.parametrize("mode", ["union", "client", "source"])
def test_similarity_modes(spark, mode):
    """One mark alone, which decides."""
    rules = SimilarityRules(min_appearance=0)
    df = frame(spark, [("red apple", "red apple big sweet round", True), ("red apple big sweet round", "red apple", False), ("red", "red", True)])
    whole = {r.pair_id: r for r in similarity.validate_similarity(df, "client", "source", rules, 1.0, 0.9).collect()}
    out = similarity.validate_similarity(df, "client", "source", rules, 1.0, 0.9, mode)
    assert out.columns == [*df.columns, f"{mode}_mark", "fuzzy validation"]
    for r in out.collect():
        assert r[f"{mode}_mark"] == whole[r.pair_id][f"{mode}_mark"] and r["fuzzy validation"] == (r[f"{mode}_mark"] >= 0.9)
    assert {r.pair_id: r["fuzzy validation"] for r in out.collect()} == {0: int(mode == "client"), 1: int(mode == "source"), 2: 1}
    with pytest.raises(ValueError):
        similarity.validate_similarity(df, "client", "source", rules, mode="other")


def brute_marks(rows, rules, fuzzy):
    """id: (union, client, source), for names of lower-case Latin words; rates by the square root of counts."""
    sets = {}
    for i, a, b in rows:
        left, right = (list(dict.fromkeys(w for w in t.split() if len(w) >= rules.word_min_length and any(c.isalpha() for c in w))) for t in (a, b))
        moved = []
        for w in left:
            if w not in right:
                best = sorted((-scores.token_score(w, r), r) for r in right)
                w = best[0][1] if best and -best[0][0] >= 100 * fuzzy else w
            moved.append(w)
        sets[i] = moved, right
    counts = Counter(w for pair in sets.values() for side in pair for w in side)
    rate = {w: max(rules.min_ratio, min(rules.max_ratio, n**-0.5)) * (rules.min_appearance_penalty if rules.min_appearance and n <= rules.min_appearance else 1) for w, n in counts.items()}
    out = {}
    for i, (left, right) in sets.items():
        a, b = set(left), set(right)
        both, bases = sum(rate[w] for w in a & b), [sum(rate[w] for w in x) for x in (a | b, a, b)]
        out[i] = tuple(both / x if x else 0.0 for x in bases)
    return out


@pytest.mark.parametrize("fuzzy", [1.0, 0.75])
def test_marks_by_brute_force(spark, fuzzy):
    rng, words = random.Random(6), "apple aple apples pear pears peer plum plums prune redish reddish red blue bluish abcdefghij a1 zz".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(150)]
    rows += [(1000 + i, *rows[0][1:]) for i in range(40)]  # equal pairs count each time
    df = spark.createDataFrame(rows, "pair_id long, client string, source string")
    want = brute_marks(rows, load_similarity_rules(), fuzzy)
    got = similarity.validate_similarity(df, "client", "source", load_similarity_rules(), fuzzy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert all(abs(x - y) < 1e-9 for x, y in zip((r.union_mark, r.client_mark, r.source_mark), want[r.pair_id]))


def test_similarity_query_by_brute_force(spark, sf_dir):
    """s9's rows on the smallest tables: the names there are lower-case Latin words and numbers."""
    import __spark_entry__ as entry
    from wareknit.plans import inputs

    pairs = inputs.pairs(spark, sf_dir).collect()
    assert all(t == t.lower() and t.isascii() for r in pairs for t in (r.client, r.source))
    want = brute_marks([(k, r.client, r.source) for k, r in enumerate(pairs)], load_similarity_rules(), 0.75)
    shown = lambda r: tuple(r[k] for k in inputs.PAIR_KEYS)
    # Keys may repeat: rows are compared as a bag.
    theirs = sorted((shown(r), *want[k], want[k][0]) for k, r in enumerate(pairs))
    mine = sorted((shown(r), r.union_mark, r.client_mark, r.source_mark, r.decision) for r in entry.queries()["s9_similarity"](spark, sf_dir).collect())
    assert len(mine) == len(theirs) == len(pairs)
    for m, t in zip(mine, theirs):
        assert m[0] == t[0] and all(abs(x - y) < 2e-6 for x, y in zip(m[1:4], t[1:4])) and m[4] == (t[4] >= 0.5 - 1e-12)
    assert len({m[1:4] for m in mine}) > 2


def test_no_break_spaces(spark):
    """White space, digits' neighbours and word edges are those of Unicode in all searches."""
    for blank in ("\u00a0", "\u202f", "\u2009"):
        swap = lambda rows: [(a.replace(" ", blank), b.replace(" ", blank), e) for a, b, e in rows]  # noqa: E731, B023
        rows = swap(P.HAND["volume"] + P.HAND["quantity"]) + [(f"Вода 10{blank}мл", "Вода 10 мл", True), (f"Вода 10{blank}мл", f"Вода 20{blank}мл", False)]
        assert wrong_features(spark, rows) == []
        df = measures.extract_measures(frame(spark, rows), "client", OVERALL)
        assert measures.match_regex(df, "source", "Regex").filter("matched <> is_equal").count() == 0
    one = spark.createDataFrame([("Вода 10\u00a0мл",)], "name string")
    assert "10" in measures.extract_measures(one, "name", RULES).head().Regex


def test_match_names(spark):
    """As matching row by row, nulls being empty names."""
    rows = [*P.HAND["weight"], *P.HAND["weight"][:3], (None, "Соль 2кг", False), ("Соль 2кг", None, False), (None, None, True)]
    df = frame(spark, rows)
    slow = measures.match_regex(measures.extract_measures(df, "client", OVERALL, regex_col="r"), "source", "r", "m")
    got = {r.pair_id: r.matched for r in measures.match_names(df, "client", "source", OVERALL).collect()}
    assert got == {r.pair_id: r.m for r in slow.collect()} and len(got) == len(rows)


def brute_cross(rows, nearest=0):
    out = {i: (set(), set(), set()) for i, _, _ in rows}
    order = {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for (i, ta, a), (j, tb, b) in itertools.permutations(rows, 2):
        if nearest and abs(order[i] - order[j]) > nearest:
            continue
        a, b = set(a), set(b)
        if a < b and len(b) == len(a) + 1:
            (w,) = b - a
            if w not in ta.lower():
                out[i][0].add(w)
            if w in tb.lower():
                out[j][1].add(w)
        if len(a - b) == 1 == len(b - a):
            (w,) = a - b
            if w in ta.lower():
                out[i][2].add(w)
    return {i: tuple(sorted(s) for s in v) for i, v in out.items() if any(v)}


@pytest.mark.parametrize("nearest", [0, 5, 500])
@pytest.mark.parametrize("partitions", [1, 8])
def test_cross_words_against_all_pairs(spark, nearest, partitions):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        tokens = sorted(rng.sample(["red", "blue", "big", "old", "cup", "jar"], rng.randint(0, 4)))
        rows.append((i, " ".join(tokens) if rng.random() < 0.9 else "other", tokens))
    df = spark.createDataFrame(rows, "id long, text string, tokens array<string>").repartition(partitions)
    got = {r.id: (r.cross_minus, r.cross_plus, r.cross_intersect) for r in cross.cross_words_of(df, "id", "text", "tokens", nearest).collect()}
    got = {k: v for k, v in got.items() if any(v)}
    assert got == brute_cross(rows, nearest)


def test_cross_words_job(spark):
    df = spark.createDataFrame([(1, "cup red 5 кг"), (2, "cup red big 5 кг"), (3, "cup blue"), (4, None)], "id long, name string")
    df = measures.extract_measures(df, "name", RULES)
    got = {r.id: (r.cross_minus, r.cross_plus, r.cross_intersect) for r in cross.cross_words(df, "id", "name", [W.WordRule("english", min_length=3, stem=True)], None).collect()}
    assert got == {1: ("big", "", "red"), 2: ("", "big", ""), 3: ("", "", "blue"), 4: ("", "", "")}


@pytest.mark.parametrize("nearest", [0, 4])
def test_cross_words_by_whole_names(spark, nearest):
    """Words come from the stripped names; order and presence go by the names themselves."""
    rng, rows = random.Random(9), [(1, "cup big", "(?=.*(big))"), (2, "cup big old", "(?=.*(old))")]
    for i in range(3, 90):
        words = rng.sample(["red", "blue", "big", "old", "cup", "jar"], rng.randint(1, 4))
        rows.append((i, " ".join(words), rng.choice(["", *(f"(?=.*({w}))" for w in words)])))
    gone = lambda r: r[2].removeprefix("(?=.*(").removesuffix("))")
    brute = brute_cross([(r[0], r[1], sorted(set(r[1].split()) - {gone(r)})) for r in rows], nearest)
    df = spark.createDataFrame(rows, "id long, name string, Regex string")
    out = cross.cross_words(df, "id", "name", [W.WordRule("english", min_length=3)], "Regex", nearest)
    got = {r.id: tuple(sorted(filter(None, x.split("|"))) for x in (r.cross_minus, r.cross_plus, r.cross_intersect)) for r in out.collect()}
    assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in brute.items()}
    if not nearest:
        assert "big" not in got[1][0]
    only = cross.cross_words(df, "id", "name", [W.WordRule("english", min_length=3)], "Regex", nearest, ("cross_intersect",))
    assert only.columns == [*df.columns, "cross_intersect"]
    assert {r.id: r.cross_intersect for r in only.collect()} == {r.id: r.cross_intersect for r in out.collect()}


def test_rows_without_tokens(spark):
    """A thousand rows without tokens beside five hundred single words: one set of words for each signature."""
    rng = random.Random(5)
    rows = [(i, "" if i % 3 else f"w{i}", []) for i in range(1000)] + [(2000 + i, f"w{i} x", [f"w{i}"]) for i in range(500)]
    rows += [(4000 + i, f"w{i} v{i % 7}", [f"v{i % 7}", f"w{i}"]) for i in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "id long, text string, tokens array<string>").repartition(8)
    found = cross.cross_words_of(df, "id", "text", "tokens")
    got = {r.id: (r.cross_minus, r.cross_plus, r.cross_intersect) for r in found.collect()}
    small = [r for r in rows if r[0] < 40 or r[0] >= 2000]
    want = brute_cross(small)  # what a row finds depends on its own tokens and on the other rows' words
    assert all(got[i] == want[i] for i, _, _ in small if i < 40)
    many = {i: tuple(sorted({f"w{k}" for k in range(500)} - ({f"w{i}"} if not i % 3 else set()) - {w for w in [f"w{i}"[:k] for k in range(2, 6)] if not i % 3})) for i in range(1000)}
    assert all(tuple(got[i][0]) == many[i] and got[i][1:] == ([], []) for i in range(1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "explode(set" not in plan


def test_cross_words_query_by_brute_force(spark, sf_dir):
    """x4's rows on the smallest tables, where every row is within 250 places of every other."""
    import re

    import __spark_entry__ as entry
    from wareknit.plans import inputs

    parts = measures.extract_measures(inputs.catalog(spark, sf_dir), "name", RULES).select("p_partkey", "name", "Regex").collect()
    rows = []
    for p in parts:
        text = p.name + " "
        for body in re.findall(r"\(\?=\.\*.*?\)\)+", p.Regex):
            text = re.sub(body.removeprefix("(?=.*(").removesuffix("))"), "", text, flags=re.I)
        words = [w.lower() for w in re.findall(r"\b[A-Za-z0-9]+\b", text) if len(w) >= 3 and re.search("[a-z]", w.lower())]
        rows.append((p.p_partkey, p.name, sorted({scores.stem_english(w) for w in words})))
    want = brute_cross(rows, 250)
    assert len(rows) <= 250 and sum(any(v) for v in want.values()) > 50
    for r in entry.queries()["x4_cross_words_job"](spark, sf_dir).collect():
        assert (r.cross_minus, r.cross_plus, r.cross_intersect) == tuple("|".join(ws) for ws in want.get(r.p_partkey, ((), (), ())))


def test_stored_features(spark, tmp_path):
    """As deciding each pair; a second batch finds only new names' features."""
    rows = [*P.HAND["weight"], *P.HAND["volume"], *P.COMPLEX, (None, "Соль 2кг", False), (None, None, True)]
    df, path = frame(spark, rows + rows[:5]).withColumn("client_name", F.lit("kept")), f"file://{tmp_path}/features"
    order = lambda d: sorted(map(str, d.collect()))
    want = features.validate_features(df, "client", "source", RULES)
    assert order(features.validate_names(df, "client", "source", RULES, path=path).select(want.columns)) == order(want)
    before = spark.read.parquet(path).count()
    assert before == df.select(F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in ("client", "source")]))).distinct().count()
    more = frame(spark, [*rows[:3], ("Мука 77г", "Мука 0.077 кг", True), ("Мука 77г", rows[0][1], False)])
    got = features.validate_names(more, "client", "source", RULES, path=path)
    assert got.filter((F.col("features validation") == 1) != F.col("is_equal")).count() == 0
    assert spark.read.parquet(path).count() == before + 2
    other = features.validate_names(more, "client", "source", RULES, True, path=path)
    assert other.count() == 5 and spark.read.parquet(path).select("rules").distinct().count() == 2
    assert features.validate_names(df.limit(0), "client", "source", RULES).count() == 0


def test_best_substring_by_letter_counts(monkeypatch):
    """Scores as by comparing each stretch, with a fifth of the comparisons on long rows."""

    def slow(a, b):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        stretches = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        return max(scores.similarity(short, w) for w in stretches) if short else 0.0

    rng = random.Random(4)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randint(0, n))) for n in (6, 25))
        assert scores.best_substring(a, b) == slow(a, b)
    calls, real = [], scores.similarity
    monkeypatch.setattr(scores, "similarity", lambda a, b: calls.append(1) or real(a, b))
    text = "".join(rng.choice("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф ") for _ in range(20_000))
    for word in ("чайник", "половник", "эмалированный"):
        assert scores.best_substring(word, text) == slow(word, text)
        compared = sum(w[-1] in word or w[0] in word for w in (text[max(0, s) : s + len(word)] for s in range(1 - len(word), len(text))))
        calls.clear()
        scores.best_substring(word, text)
        assert 5 * len(calls) < compared


def test_offers(spark):
    rules = spark.createDataFrame([("p", "|red|cup|", "old|", "(?=.*(cup))"), ("q", None, "", None), ("s", "", "", "abc")], "product string, plus_words string, minus_words string, regex string")
    rows = [("p", "Red Cup"), ("p", "red jar"), ("p", "old red cup"), ("q", "x"), ("none", "y"), ("s", "xabc"), ("s", "ABCd"), ("q", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "offer_id long, product string, row_text string")
    got = {r.offer_id: (r.reason, r.validation_mark) for r in offers.validate_offers(df, rules).collect()}
    assert got == {0: ("111", 1), 1: ("100", 0), 2: ("011", 0), 3: ("111", 1), 4: ("111", 1), 5: ("110", 0), 6: ("111", 1), 7: ("111", 1)}
    scored = lambda **k: {r.offer_id: round(r.validation_mark, 4) for r in offers.score_offers(df, rules.filter("product = 'p'").withColumn("plus_words", F.lit("red|cup")).withColumn("minus_words", F.lit("old")), **k).collect()}
    assert [scored()[i] for i in range(4)] == [1.0, 0.5, 0.75, 0.0]
    assert scored(weights={"plus": 3.0})[1] == 0.5 and scored(strict=frozenset({"minus"}))[2] == 0.0
    assert scored(fuzzy=frozenset({"plus"}))[1] == pytest.approx((1 + scores.best_substring("cup", "red jar") / 100 + 1 + 0) / 4, abs=0.01)
    with pytest.raises(ValueError):
        scored(fuzzy=frozenset({"plus"}), strict=frozenset({"plus"}))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', ["x"])], "id long, name string, l array<string>")
    write_result(df, f"{tmp_path}/t.csv", "csv")
    assert [tuple(r) for r in read_products(spark, f"{tmp_path}/t.csv", ["name"]).collect()] == [("1", 'a "b", c', '["x"]')]
    write_result(df, f"{tmp_path}/t", "parquet")
    with pytest.raises(ValueError):
        read_products(spark, f"{tmp_path}/t", ["missing"])


def test_plans_stay_narrow(spark):
    df = frame(spark, P.COMPLEX)
    plan = features.validate_features(df, "client", "source", RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")
