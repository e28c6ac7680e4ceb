"""Does an offer satisfy its product's plus-words, minus-words and expression?

Rule tables are checked first: each distinct pattern of a catalogue is compiled once, and a list with a pattern that
doesn't compile is set aside, so that only what depends on that list stays undecided.

A catalogue's distinct rules are numbered. Each distinct pair of offer text and rule is decided once, and joined back. The
pairs are sorted by rule inside each partition, and each check of a validation is one search with one pattern, of which
Spark keeps the last: a rule's patterns are compiled once in a partition, not for each offer. A rule with very many offers
is spread by their texts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareknit.functions.scores import partial_ratio
from wareknit.functions.words import text_of
from wareknit.operators.measures import ANY_CASE, LOOKAHEAD
from wareknit.plans.scratch import free_name, spread, written

RULE_COLUMNS = ("plus_words", "minus_words", "regex")
LISTS = {"minus": "minus_words", "plus": "plus_words", "regex": "regex"}
#: In a reason, instead of a digit: the list can't be decided.
UNDECIDED = "e"


class Checked(NamedTuple):
    rules: DataFrame  # rule, plus_words, minus_words, regex (nulls as empty), bad_minus, bad_plus, bad_regex; rule: a number
    bad: DataFrame  # list, words, pattern: patterns that don't compile, and the list they stand in


def none() -> Column:
    return F.array().cast("array<string>")


def trimmed(rule: str | Column) -> Column:
    """A list without bars at its ends; empty for null."""
    return F.regexp_replace(text_of(rule), r"^\||\|$", "")


def words_of(words: Column) -> Column:
    return F.when(words == "", none()).otherwise(F.split(words, r"\|"))


def from_start(regex: Column) -> Column:
    return F.concat(F.lit("^(?:"), regex, F.lit(")"))


def whole_patterns() -> dict[str, Column]:
    """What a validation looks for: minus-words as one alternation, each plus-word, the expression from the row's start."""
    one = lambda c, shown: F.when(c == "", none()).otherwise(F.array(shown))
    return {"minus": one(trimmed("minus_words"), trimmed("minus_words")), "plus": words_of(trimmed("plus_words")), "regex": one(text_of("regex"), from_start(text_of("regex")))}


def single_patterns() -> dict[str, Column]:
    """What a score looks for: each word, and each body of the expression."""
    return {"minus": words_of(text_of("minus_words")), "plus": words_of(text_of("plus_words")), "regex": F.regexp_extract_all(text_of("regex"), F.lit(LOOKAHEAD), 0)}


def compiles(pattern: Column) -> Column:
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit(ANY_CASE), pattern)).isNotNull()


def check_rules(catalog: DataFrame, patterns: dict[str, Column] | None = None) -> Checked:
    """The catalogue's distinct rules with flags of lists that hold a pattern that doesn't compile, and those patterns.

    patterns: what is looked for of each list; by default, what a validation looks for.
    """
    patterns = patterns or whole_patterns()
    # Written once: the numbers of a second evaluation could differ.
    rules = written(catalog.select(*[text_of(c).alias(c) for c in RULE_COLUMNS]).distinct().withColumn("rule", F.monotonically_increasing_id()), "rules")
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.col(LISTS[k]).alias("words"), p.alias("patterns")) for k, p in patterns.items()])
    stands = rules.select("rule", F.explode(lists).alias("s")).select("rule", "s.list", "s.words", F.explode("s.patterns").alias("pattern"))
    stands = written(stands, "rule-patterns")
    wrong = written(stands.select("pattern").distinct().filter(~compiles(F.col("pattern"))), "bad-patterns")
    bad = written(stands.join(wrong, "pattern", "left_semi"), "bad-rules")
    flags = bad.groupBy("rule").agg(*[F.max(F.col("list") == k).alias(f"bad_{k}") for k in LISTS])
    flagged = rules.join(flags, "rule", "left").withColumns({f"bad_{k}": F.coalesce(f"bad_{k}", F.lit(False)) for k in LISTS})
    return Checked(written(flagged, "checked-rules"), bad.select("list", "words", "pattern").distinct())


def join_rules(offers: DataFrame, catalog: DataFrame, left_on: str = "product", right_on: str = "product") -> DataFrame:
    """Offers with their product's rules; a product named twice in the catalogue gives an offer twice."""
    rules = catalog.select(F.col(right_on).alias("__product"), *RULE_COLUMNS)
    return offers.join(rules, offers[left_on] == F.col("__product"), "left").drop("__product")


def has(text: str | Column, pattern: Column) -> Column:
    """Is the pattern found? (Spark keeps the last pattern of this search, and compiles rlike's for each row.)"""
    return F.regexp_instr(text_of(text), F.concat(F.lit(ANY_CASE), pattern)) > 0


def check_minus(text: str, minus: str = "minus_words") -> Column:
    return (trimmed(minus) == "") | ~has(text, trimmed(minus))


#: Words with these can't stand beside others in one pattern: numbered and named groups, quotes, comments and other flags.
ALONE = r"\\[0-9kQ]|\(\?[^:=!]"


def check_plus(text: str, plus: str = "plus_words") -> Column:
    """All words are found: looked for from the row's start, each for itself, in one pattern."""
    words = words_of(trimmed(plus))
    ahead = F.transform(words, lambda w: F.concat(F.lit(r"(?=[\s\S]*?(?:"), w, F.lit("))")))
    together = has(text, F.concat(F.lit("^"), F.array_join(ahead, "")))
    return (trimmed(plus) == "") | F.when(text_of(plus).rlike(ALONE), F.forall(words, lambda w: has(text, w))).otherwise(together)


def check_regex(text: str, regex: str = "regex") -> Column:
    """Matched from the start of the row."""
    return (text_of(regex) == "") | has(text, from_start(text_of(regex)))


def numbered(offers: DataFrame, catalog: DataFrame, checked: Checked, left_on: str, right_on: str, rule: str) -> DataFrame:
    """offers with the number of their product's rule, null without one."""
    numbers = checked.rules.select("rule", *[F.col(c).alias(f"own_{c}") for c in RULE_COLUMNS])
    same = [text_of(catalog[c]) == numbers[f"own_{c}"] for c in RULE_COLUMNS]
    product = free_name(offers, "rule_product")
    named = catalog.join(numbers, reduce(Column.__and__, same)).select(F.col(right_on).alias(product), F.col("rule").alias(rule))
    return offers.join(named, offers[left_on] == F.col(product), "left").drop(product)


def decided(offers: DataFrame, catalog: DataFrame, checked: Checked, text_col: str, left_on: str, right_on: str, decide) -> DataFrame:
    """offers with the columns that decide() adds to a table of row (text), rule and the rule's columns; null without a rule."""
    rule, row = free_name(offers, "rule_number"), free_name(offers, "row")
    joined = numbered(offers, catalog, checked, left_on, right_on, rule).withColumn(row, text_of(text_col))
    once = written(joined.select(F.col(row).alias("row"), F.col(rule).alias("rule")).filter("rule is not null").distinct(), "offer-texts")
    found = decide(spread(once.join(checked.rules, "rule"), "row", "rule").sortWithinPartitions("rule"))
    # Written, so that the join back is one of two plain tables, whose frequent keys Spark can split.
    found = written(found.withColumnsRenamed({"row": row, "rule": rule}), "decided-offers")
    return joined.join(found, [row, rule], "left").drop(row, rule)


def reason_of(text: str) -> Column:
    """A digit each for minus, plus and regex, or e; rows with the columns of checked rules."""
    checks = {"minus": check_minus(text), "plus": check_plus(text), "regex": check_regex(text)}
    return F.concat(*[F.when(F.col(f"bad_{k}"), UNDECIDED).when(c, "1").otherwise("0") for k, c in checks.items()])


def with_mark(df: DataFrame) -> DataFrame:
    df = df.withColumn("reason", F.coalesce("reason", F.lit("111")))
    return df.withColumn("validation_mark", F.when(F.col("reason") == "111", 1).when(F.col("reason").contains("0"), 0))


def validate_offers(offers: DataFrame, catalog: DataFrame, text_col: str = "row_text", left_on: str = "product", right_on: str = "product") -> DataFrame:
    """offers with validation_mark (1: all checks pass) and reason (a digit each for minus, plus and regex).

    A list with a pattern that doesn't compile has the digit e; the mark is then 0 if another check fails, else null.
    """
    decide = lambda pairs: pairs.select("row", "rule", reason_of("row").alias("reason"))
    return with_mark(decided(offers.drop("reason", "validation_mark"), catalog, check_rules(catalog), text_col, left_on, right_on, decide))


def validate_each(offers: DataFrame, catalog: DataFrame, text_col: str = "row_text", left_on: str = "product", right_on: str = "product") -> DataFrame:
    """As validate_offers, each offer where it lies: for streams, and for batches whose offers are all different."""
    checked, rule, offers = check_rules(catalog), free_name(offers, "rule_number"), offers.drop("reason", "validation_mark")
    own = checked.rules.select(F.col("rule").alias(rule), *[F.col(c).alias(f"__{c}") for c in RULE_COLUMNS], *[F.col(f"bad_{k}").alias(f"__bad_{k}") for k in LISTS])
    row = free_name(offers, "row")
    df = numbered(offers, catalog, checked, left_on, right_on, rule).join(own, rule, "left")
    kept = df.select(*[F.struct(*[F.col(f"`{c}`") for c in offers.columns]).alias(row)], F.col(f"`{text_col}`").alias("text"), *[F.col(f"__{c}").alias(c) for c in RULE_COLUMNS], *[F.coalesce(f"__bad_{k}", F.lit(False)).alias(f"bad_{k}") for k in LISTS])
    return with_mark(kept.select(f"{row}.*", reason_of("text").alias("reason")))


def score_offers(
    offers: DataFrame,
    catalog: DataFrame,
    weights: dict[str, float] | None = None,
    fuzzy: frozenset[str] = frozenset(),
    strict: frozenset[str] = frozenset(),
    text_col: str = "row_text",
    left_on: str = "product",
    right_on: str = "product",
) -> DataFrame:
    """offers with validation_mark: weighted hits over the weighted number of rules.

    Plus-words that are found, minus-words that aren't and expression bodies that match are hits. fuzzy ("plus",
    "minus"): a word counts by the similarity of its best substring. strict ("plus", "minus", "regex"): a list that
    isn't hit completely makes the mark 0; a list can't be both. A list with a pattern that doesn't compile makes the
    mark null, unless it is fuzzy: then its words are texts.
    """
    weights = {"plus": 1.0, "minus": 1.0, "regex": 1.0} | (weights or {})
    if both := fuzzy & strict:
        raise ValueError(f"{', '.join(sorted(both))} can't be fuzzy and strict together")

    def decide(pairs: DataFrame) -> DataFrame:
        lists = single_patterns()
        df, hits = pairs.withColumns({f"l_{k}": v for k, v in lists.items()}), {}
        for k in lists:
            if k in fuzzy:
                df, hits[k] = with_fuzzy_hits(df, k), F.col(f"hits_{k}")
            else:
                # A word is looked for in the row as an expression; so is a body of the product's.
                hit = (lambda w: ~has("row", w)) if k == "minus" else (lambda w: has("row", w))
                hits[k] = F.when(~F.col(f"bad_{k}"), F.size(F.filter(f"l_{k}", hit)).cast("double"))
        total = sum((F.size(f"l_{k}") * F.lit(float(weights[k])) for k in lists), F.lit(0.0))
        got = sum((hits[k] * F.lit(float(weights[k])) for k in lists), F.lit(0.0))
        mark = F.when(total > 0, got / total).otherwise(0.0)
        for k in strict:
            mark = F.when(hits[k] < F.size(f"l_{k}"), 0.0).otherwise(mark)
        return df.select("row", "rule", mark.alias("validation_mark"), F.lit(True).alias("scored"))

    scored = free_name(offers, "scored")
    df = decided(offers.drop("validation_mark"), catalog, check_rules(catalog, single_patterns()), text_col, left_on, right_on, lambda p: decide(p).withColumnRenamed("scored", scored))
    return df.withColumn("validation_mark", F.when(F.col(scored), F.col("validation_mark")).otherwise(0.0)).drop(scored)


def with_fuzzy_hits(df: DataFrame, kind: str) -> DataFrame:
    """df (row, rule, l_kind, …) with the sum of the words' scores; each distinct word and row text is scored once."""
    words = df.select("row", "rule", F.explode(f"l_{kind}").alias("w"))
    # Written: a word that all rules of a row share is a frequent key of the join.
    scores = written(spread(words.select("row", "w").distinct(), "row", "w").withColumn("s", partial_ratio(F.col("w"), F.col("row")) / 100), "word-scores")
    share = F.col("s") if kind == "plus" else 1 - F.col("s")
    sums = words.join(scores, ["row", "w"]).groupBy("row", "rule").agg(F.sum(share).alias(f"hits_{kind}"))
    return df.join(sums, ["row", "rule"], "left").withColumn(f"hits_{kind}", F.coalesce(f"hits_{kind}", F.lit(0.0)))
