"""How alike are two names? Rarity-weighted Jaccard after fuzzy alignment of tokens.

Token rates are counted over both columns of the whole batch; counts pre-aggregate before they shuffle. Fuzzy scores are
computed once for each distinct pair of tokens. Rates and scores are stored with their counts, so that the rows of frequent
tokens and pairs of tokens find them without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareknit.functions.scores import token_similarity
from wareknit.functions.words import LETTERS, UPPER, WordRule, extract_words, text_of
from wareknit.plans.lookup import looked_up
from wareknit.plans.rules import SimilarityRules
from wareknit.plans.scratch import free_name, spread, written

LANGUAGES = {"rus": "russian", "eng": "english"}
CLASSES = ("caps", "capital", "low", "other")


def clean_names(col: str | Column, clean: str = "as_is") -> Column:
    """Deletes apostrophes, slashes and the two characters |" side by side; "quotes": each quote and bar by itself."""
    return F.regexp_replace(text_of(col), "'|\\|\"|/" if clean == "as_is" else "['\"|/]", "")


def weighted_tokens(col: str | Column, rules: SimilarityRules) -> Column:
    """array<struct<value, original, cls, weight>> by language (Russian first), then letter case class.

    A token is a whole word of one script's letters and digits with a letter among them; a word that starts with a
    digit counts as capital.
    """
    class_weight, out = dict(rules.class_weights), []

    def token(up: str, weight: float):
        def of(w: Column) -> Column:
            cls = F.when(w.rlike(f"^[{up}0-9]+$"), 0).when(w.rlike(f"^[{up}0-9]"), 1).otherwise(2)
            share = F.when(cls == 0, class_weight["caps"]).when(cls == 1, class_weight["capital"]).otherwise(class_weight["low"])
            return F.struct(cls.alias("cls"), F.lower(w).alias("value"), w.alias("original"), (share * F.lit(weight)).cast("double").alias("weight"))

        return of

    for key, weight in rules.language_weights:
        low, up = LETTERS[LANGUAGES[key]], UPPER[LANGUAGES[key]]
        words = F.filter(F.regexp_extract_all(text_of(col), F.lit(rf"(?U)\b([{up}{low}0-9]+)\b"), 1), lambda w: w.rlike(f"[{up}{low}]"))
        # Sorting by class keeps text order inside a class: the place goes between.
        placed = F.transform(F.transform(words, token(up, weight)), lambda t, i: F.struct(t["cls"].alias("cls"), i.alias("at"), t.alias("t")))
        out.append(F.transform(F.array_sort(placed), lambda p: p["t"]))
    return F.transform(F.concat(*out), lambda t: F.struct(t["value"].alias("value"), t["original"].alias("original"), t["cls"].alias("cls"), t["weight"].alias("weight")))


def staged_tokens(df: DataFrame, columns: dict[str, Column], rules: SimilarityRules) -> DataFrame:
    """df with tokens (as of weighted_tokens) of each column's text, by the rules' symbols and boundaries.

    For each language and class in turn, words are found and deleted, and what is left goes to the next: a custom boundary
    is used up with its word, and "other" takes words without a letter, where a deletion has brought any to light. Each
    text is a column of its own select, so that it is computed once.
    """
    weights, parts, text = dict(rules.class_weights), {n: [] for n in columns}, {n: free_name(df, f"{n}_text") for n in columns}
    df = df.withColumns({text[n]: text_of(c) for n, c in columns.items()})
    for key, weight in rules.language_weights:
        for cls, kind in enumerate(CLASSES):
            rule = WordRule(LANGUAGES[key], {"caps": "caps", "capital": "capital"}.get(kind, "any"), True, rules.symbols, rules.word_boundary, rules.custom_boundary, kind != "other")

            def token(w: Column) -> Column:
                share = F.lit(float(weights[kind]) * weight)  # noqa: B023
                return F.struct(F.lower(w).alias("value"), w.alias("original"), F.lit(cls).alias("cls"), share.alias("weight"))  # noqa: B023

            new, after = {}, {}
            for n in columns:
                # Blanks are widened, so that two words never share one as their boundary.
                spaced = F.replace(F.concat(F.lit("  "), F.col(text[n]), F.lit("  ")), F.lit(" "), F.lit("   "))
                parts[n].append(own := free_name(df, f"{n}_{key}_{kind}"))
                new[own] = F.transform(extract_words(spaced, rule), token)
                after[text[n]] = F.regexp_replace(F.regexp_replace(spaced, rule.bounded, " "), " +", " ")
            df = df.withColumns(new | after)
    df = df.withColumns({n: F.concat(*[F.col(p) for p in parts[n]]) for n in columns})
    return df.drop(*text.values(), *[p for ps in parts.values() for p in ps])


def with_tokens(df: DataFrame, columns: dict[str, Column], rules: SimilarityRules) -> DataFrame:
    """df with the prepared tokens of each column's text. Without symbols and with plain boundaries, one search does."""
    if rules.symbols or rules.custom_boundary or not rules.word_boundary:
        df = staged_tokens(df, columns, rules)
    else:
        df = df.withColumns({n: weighted_tokens(c, rules) for n, c in columns.items()})
    # A select of its own: inside one expression, all tokens would be found again for each token.
    return df.withColumns({n: prepare_tokens(F.col(n), rules.word_min_length) for n in columns})


def prepare_tokens(tokens: Column, min_length: int) -> Column:
    """Tokens of min_length letters or more; of equal values the first."""
    long = F.filter(tokens, lambda t: F.length(t["value"]) >= min_length)
    values = F.transform(long, lambda t: t["value"])
    return F.filter(long, lambda t, i: F.array_position(values, t["value"]) == i + 1)


def name_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n: how often each text stands in the columns; a null is an empty one."""
    # Rows with the same texts in all columns meet first: one row each goes on, not one for each column.
    same = df.groupBy(*[text_of(c).alias(f"c{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("n"))
    return same.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))


def once_for_names(pairs: DataFrame, client: str, source: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs with the columns that make() adds to a table of the distinct pairs of names (client, source), once for each.

    They replace pairs' own columns of the same names; a null is an empty name.
    """
    c, s = (free_name(pairs, n) for n in ("client_name", "source_name"))
    keyed = pairs.withColumns({c: text_of(client), s: text_of(source)})
    once = written(keyed.select(F.col(c).alias("client"), F.col(s).alias("source")).distinct(), "name-pairs")
    # Written, so that the join back is one of two plain tables: a small one is broadcast, frequent keys of a large one Spark can split.
    made = written(make(spread(once, "client", "source")).withColumnsRenamed({"client": c, "source": s}), "made-for-names")
    return keyed.drop(*[n for n in made.columns if n not in (c, s)]).join(made, [c, s]).drop(c, s)


def align_tokens(pairs: DataFrame, left: str, right: str, threshold: float = 0.75) -> DataFrame:
    """pairs with left tokens' values replaced by those of their best right tokens.

    A token that stands on the right as it is stays; else the best-scoring right token, the smallest of equal ones,
    takes its place if it scores threshold or more. Matched tokens share the larger weight. Equal pairs of lists are
    aligned once; a null list is an empty one.
    """
    number, own, other = (free_name(pairs, n) for n in ("lists", "own_left", "own_right"))
    empty = lambda c: F.coalesce(c, F.array().cast(pairs.schema[c].dataType))
    keyed = pairs.withColumns({left: empty(left), right: empty(right)})
    # Written once: the numbers of a second evaluation could differ.
    lists = written(keyed.select(left, right).distinct().withColumn(number, F.monotonically_increasing_id()), "token-lists")
    moved = align_lists(lists, number, left, right, threshold)
    aligned = written(lists.withColumnsRenamed({left: own, right: other}).join(moved, number).drop(number), "aligned-lists")
    both = keyed.withColumnsRenamed({left: own, right: other}).join(aligned, [own, other])
    return both.select(*pairs.columns)


def align_lists(pairs: DataFrame, id_col: str, left: str, right: str, threshold: float = 0.75) -> DataFrame:
    """align_tokens for pairs whose id_col is their own."""
    open_ = pairs.select(id_col, F.explode(left).alias("l"), F.col(right).alias("r")).filter(~F.exists("r", lambda t: t["value"] == F.col("l.value")))
    both = open_.select(id_col, F.col("l.value").alias("lv"), F.explode("r").alias("t")).select(id_col, "lv", F.col("t.value").alias("rv"))
    # A score is at most what the lengths allow: whole texts in common, or a share of a whole substring.
    a, b = F.length("lv"), F.length("rv")
    short, long = F.least(a, b), F.greatest(a, b)
    most = F.greatest(F.round(200 * short / (a + b)), F.when(long < 1.5 * short, 0).when(long <= 8 * short, 90).otherwise(60))
    possible = both.filter((short == 0) | (most >= 100 * threshold))
    scores = spread(possible.groupBy("lv", "rv").agg(F.count("*").alias("n")), "lv", "rv").withColumn("score", token_similarity(F.col("lv"), F.col("rv")))
    found = looked_up(possible, written(scores, "token-scores"), ["lv", "rv"], "n").filter(F.col("score") >= 100 * threshold)
    best = found.groupBy(id_col, "lv").agg(F.min(F.struct((-F.col("score")).alias("s"), "rv")).alias("b"))
    maps = best.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lv", F.col("b.rv").alias("rv")))).alias("__to"))
    joined = pairs.join(maps, id_col, "left")
    to = lambda t: F.coalesce(F.try_element_at(F.coalesce(F.col("__to"), F.create_map().cast("map<string,string>")), t["value"]), t["value"])
    moved = joined.withColumn(left, F.transform(left, lambda t: F.struct(to(t).alias("value"), t["original"].alias("original"), t["cls"].alias("cls"), t["weight"].alias("weight"))))

    def shared(own: str, other: str) -> Column:
        def heavier(t: Column) -> Column:
            rest = F.transform(F.filter(F.concat(own, other), lambda u: u["value"] == t["value"]), lambda u: u["weight"])
            return F.struct(t["value"].alias("value"), t["original"].alias("original"), t["cls"].alias("cls"), F.array_max(rest).alias("weight"))

        return F.transform(own, heavier)

    return moved.withColumns({left: shared(left, right), right: shared(right, left)}).drop("__to")


def rate_expr(name: str, n: Column, most: Column) -> Column:
    """Rate functions of a count; an unknown name is the default, the count itself."""
    x = n.cast("double")
    share = x / F.nullif(most, F.lit(0))
    hill = -4 * share * share + 4 * share
    functions = {
        "sqrt2": F.sqrt(x),
        "sqrt3": F.pow(x, F.lit(0.33)),
        "sqrt4": F.pow(x, F.lit(0.25)),
        "log": F.when(x != 0, F.log10(x)).otherwise(x),
        "parabaloid": F.coalesce(F.lit(1.0) / F.nullif(hill, F.lit(0.0)), F.lit(0.0)),
    }
    return functions.get(name, x)


def token_counts(df: DataFrame, columns: list[str], times: Column | None = None) -> DataFrame:
    """token, n over all rows and columns; repeated values in one row count each time. times: how often each row counts."""
    every = F.concat(*[F.transform(c, lambda t: t["value"]) for c in columns])
    tokens = df.select(F.explode(every).alias("token"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    return tokens.groupBy("token").agg(F.sum("times").alias("n"))


def token_rates(counts: DataFrame, rules: SimilarityRules) -> DataFrame:
    """token, n, rate: 1 / f(n), held between min_ratio and max_ratio; rare tokens times the penalty."""
    most = counts.agg(F.max("n").alias("most"))  # one row
    rated = counts.crossJoin(F.broadcast(most))
    value = rate_expr(rules.rate_function, F.col("n"), F.col("most"))
    held = F.greatest(F.lit(rules.min_ratio), F.least(F.lit(rules.max_ratio), F.coalesce(F.lit(1.0) / F.nullif(value, F.lit(0.0)), F.lit(0.0))))
    factor = F.when(F.col("n") <= rules.min_appearance, float(rules.min_appearance_penalty)).otherwise(1.0) if rules.min_appearance else F.lit(1.0)
    return rated.select("token", "n", (held * factor).alias("rate"))


def pair_marks(pairs: DataFrame, id_col: str, left: str, right: str, rates: DataFrame) -> DataFrame:
    """id_col, union_mark, client_mark, source_mark: common weight over that of both, of the left, of the right.

    rates: token, n, rate; a stored table, since it is read for frequent and for other tokens.
    """

    def tokens(col: str, side: int) -> DataFrame:
        return pairs.select(id_col, F.explode(col).alias("t")).select(id_col, F.col("t.value").alias("token"), F.col("t.weight").alias("weight"), F.lit(side).alias("side"))

    every = tokens(left, 1).unionByName(tokens(right, 2)).groupBy(id_col, "token").agg(F.max("weight").alias("weight"), F.max((F.col("side") == 1).cast("int")).alias("l"), F.max((F.col("side") == 2).cast("int")).alias("r"))
    weighed = looked_up(every, rates.select("token", "n", "rate"), ["token"], "n").withColumn("w", F.col("rate") * F.col("weight"))
    sums = weighed.groupBy(id_col).agg(*[F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in (("both", (F.col("l") + F.col("r")) == 2), ("of_l", F.col("l") == 1), ("of_r", F.col("r") == 1), ("of_all", F.lit(True)))])
    mark = lambda base: F.when(F.col(base) > 0, F.col("both") / F.col(base)).otherwise(0.0)
    return sums.select(id_col, mark("of_all").alias("union_mark"), mark("of_l").alias("client_mark"), mark("of_r").alias("source_mark"))


def decide(mark: Column, threshold: float = 0.5) -> Column:
    return F.when(mark >= threshold, 1).otherwise(0)


MARKS = {"union": "union_mark", "client": "client_mark", "source": "source_mark"}


def validate_similarity(
    pairs: DataFrame, client: str, source: str, rules: SimilarityRules, fuzzy_threshold: float = 0.75, validation_threshold: float = 0.5, mode: str = "multiple"
) -> DataFrame:
    """pairs with marks and `fuzzy validation`. A fuzzy threshold of 1 aligns nothing.

    mode: "multiple" gives union_mark, client_mark and source_mark and decides by the first; "union", "client" or
    "source" gives that mark alone and decides by it. Equal pairs of names are aligned and marked once, and their tokens
    count as often as they are there; a null is an empty name.
    """
    for t in (fuzzy_threshold, validation_threshold):
        if not 0 <= t <= 1:
            raise ValueError("thresholds go from 0 to 1")
    if mode != "multiple" and mode not in MARKS:
        raise ValueError("the mode is multiple, union, client or source")
    keyed = pairs.withColumns({"__client": text_of(client), "__source": text_of(source)})
    # Written once: the numbers of a second evaluation could differ.
    once = written(keyed.groupBy("__client", "__source").agg(F.count("*").alias("__n")).withColumn("__id", F.monotonically_increasing_id()), "name-pairs")
    df = with_tokens(once, {"__l": clean_names("__client"), "__r": clean_names("__source")}, rules).select("__id", "__n", "__l", "__r")
    if fuzzy_threshold < 1:
        df = align_lists(written(df, "token-lists"), "__id", "__l", "__r", fuzzy_threshold)
    df = written(df, "aligned")
    rates = written(token_rates(token_counts(df, ["__l", "__r"], F.col("__n")), rules), "token-rates")
    marks = pair_marks(df, "__id", "__l", "__r", rates)
    names = list(MARKS.values()) if mode == "multiple" else [MARKS[mode]]
    own = once.join(marks, "__id", "left").select("__client", "__source", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    out = keyed.join(own, ["__client", "__source"]).drop("__client", "__source")
    return out.withColumn("fuzzy validation", decide(F.col(names[0]), validation_threshold))
