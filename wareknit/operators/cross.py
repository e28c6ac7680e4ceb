"""Words that tell near-identical catalogue rows apart, found without comparing all rows.

A row's sorted token set T is described by its full signature and, for each token t, by the signature of T without t.
Rows A and B with B = A + {w} meet where A's full signature equals B's signature without w; rows that differ by one
word on each side meet where their signatures without that word agree. Joins are on the signature's hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareknit.functions.scores import stem
from wareknit.functions.words import WordRule, extract_words, filter_words, join_words, rule_tokens, simple_tokens, text_of
from wareknit.operators.measures import strip_by_regex
from wareknit.plans.scratch import written

SEP = "\u0001"


def signature(tokens: Column) -> Column:
    return F.concat(F.size(tokens).cast("string"), F.lit(SEP), F.array_join(tokens, SEP))


def positions(df: DataFrame, id_col: str, order_by: str) -> DataFrame:
    """id_col, pos: global place by text, then id. Ranges are sorted apart and numbered from their counts, so that no
    task sorts all rows."""
    ranged = df.select(id_col, order_by).repartitionByRange(order_by, id_col).sortWithinPartitions(order_by, id_col)
    numbered = ranged.select(id_col, F.monotonically_increasing_id().alias("n"))
    part, inside = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.select(id_col, part.cast("int").alias("part"), inside.alias("inside"))
    # Written once: the ranges of a second evaluation could differ.
    numbered = written(numbered, "positions")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    firsts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return numbered.join(F.broadcast(firsts), "part").select(id_col, (F.col("first") + F.col("inside")).alias("pos"))


def has_word(text: Column, word: Column) -> Column:
    return F.lower(text).contains(word)


KINDS = ("cross_minus", "cross_plus", "cross_intersect")


def cross_words_of(df: DataFrame, id_col: str, text: str, tokens: str, nearest: int = 0, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id_col, cross_minus, cross_plus, cross_intersect: sorted arrays of words, for rows that have any.

    cross_minus: words that another row has on top of this row's, and this text lacks; cross_plus: the same from the
    other row's side; cross_intersect: this row's word where another row differs by one word on each side.
    nearest: only rows at most so many places apart in the order of their texts count; 0: all rows.
    """
    rows = df.select(id_col, F.col(text).alias("text"), F.array_sort(F.array_distinct(tokens)).alias("T"))
    if nearest:
        rows = rows.join(positions(df, id_col, text), id_col)
    else:
        rows = rows.withColumn("pos", F.lit(0).cast("long"))
    full = rows.select(id_col, "text", "pos", signature(F.col("T")).alias("sig"))
    one = rows.select(id_col, "text", "pos", "T", F.explode("T").alias("w")).select(id_col, "text", "pos", "w", signature(F.array_except("T", F.array("w"))).alias("sig"))
    full, one = (x.withColumn("h", F.xxhash64("sig")) for x in (full, one))
    if not nearest:
        # Any other row does: what a row needs is the words themselves, as one set for each signature. Sets and signatures are
        # written, so that a frequent signature (as of rows without tokens) is a key of a plain join, which Spark can split.
        sets = written(one.groupBy("h", "sig").agg(F.collect_set("w").alias("set")), "signature-words")
        wholes = written(full.select("h", "sig").distinct(), "signatures")
        lacking = full.join(sets, ["h", "sig"]).select(id_col, F.filter("set", lambda w: ~has_word(F.col("text"), w)).alias("ws"))
        minus = lacking.filter(F.size("ws") > 0)
        own = F.array("w").alias("ws")
        plus = one.join(wholes, ["h", "sig"], "left_semi").filter(has_word(F.col("text"), F.col("w"))).select(id_col, own)
        others = sets.filter(F.size("set") > 1).select("h", "sig")
        intersect = one.join(others, ["h", "sig"], "left_semi").filter(has_word(F.col("text"), F.col("w"))).select(id_col, own)
    else:
        # Rows so near lie in the same or in neighbouring stretches of the order: a frequent signature meets by stretch.
        stretch = F.floor(F.col("pos") / (nearest + 1))
        full, one = full.withColumn("at", stretch), one.withColumn("at", stretch)
        b = one.select("h", "sig", F.col("w").alias("b_w"), F.col(id_col).alias("__b"), F.col("text").alias("b_text"), F.col("pos").alias("b_pos"), F.explode(F.array(*[F.col("at") + k for k in (-1, 0, 1)])).alias("at"))
        near = F.abs(F.col("pos") - F.col("b_pos")) <= nearest
        met = full.join(b, ["h", "sig", "at"]).filter(near)
        minus = met.filter(~has_word(F.col("text"), F.col("b_w"))).select(id_col, F.array("b_w").alias("ws"))
        plus = met.filter(has_word(F.col("b_text"), F.col("b_w"))).select(F.col("__b").alias(id_col), F.array("b_w").alias("ws"))
        pairs = one.join(b, ["h", "sig", "at"]).filter(near & (F.col("w") != F.col("b_w")) & (F.col(id_col) != F.col("__b")))
        intersect = pairs.filter(has_word(F.col("text"), F.col("w"))).select(id_col, F.array("w").alias("ws"))
    if not kinds or not set(KINDS) >= set(kinds):
        raise ValueError(f"kinds are some of {', '.join(KINDS)}")
    every = None
    for kind, found in zip(KINDS, (minus, plus, intersect)):
        if kind not in kinds:
            continue
        own = found.withColumn("kind", F.lit(kind))
        every = own if every is None else every.unionByName(own)
    words = lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == k, F.col("ws"))))))
    return every.groupBy(id_col).agg(*[words(k).alias(k) for k in kinds])


def stemmed(df: DataFrame, id_col: str, tokens: str, language: str) -> DataFrame:
    """df with stems instead of tokens; each distinct word is stemmed once."""
    words = df.select(id_col, F.explode(tokens).alias("w"))
    stems = words.select("w").distinct().withColumn("s", stem(F.col("w"), language))
    sets = words.join(stems, "w").groupBy(id_col).agg(F.array_sort(F.collect_set("s")).alias("__stems"))
    return written(df.join(sets, id_col, "left").withColumn(tokens, F.coalesce("__stems", F.array().cast("array<string>"))).drop("__stems"), "stems")


def cross_words(df: DataFrame, id_col: str, col: str, rules: list[WordRule] | None = None, regex_col: str | None = None, nearest: int = 0, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with cross_minus, cross_plus and cross_intersect, words joined by a bar, empty where there are none.

    Words come from what a row's own expression leaves of its name; the order of rows, and whether a row holds a word,
    go by the whole name. rules: words of several rules (stemmed where the rule says so); None: simple tokens. kinds:
    the columns to make.
    """
    work = df.select(id_col, text_of(col).alias("__n"), text_of(col).alias("__t"), *([regex_col] if regex_col else []))
    if regex_col:
        work = strip_by_regex(work, "__t", regex_col)
    # Names, tokens and stems are each needed several times below: they are written, not computed again.
    work = written(work.select(id_col, "__n", "__t"), "cross-names")
    if rules is None:
        work = work.withColumn("__w", simple_tokens("__t"))
    elif not any(r.stem for r in rules):
        work = work.withColumn("__w", rule_tokens("__t", rules))
    else:
        for i, r in enumerate(rules):
            words = F.transform(filter_words(extract_words("__t", r), r.min_length, r.max_words), lambda w: F.lower(w))
            work = work.withColumn(f"__w{i}", F.array_distinct(words))
            if r.stem:
                work = stemmed(work, id_col, f"__w{i}", r.language)
        work = work.withColumn("__w", F.array_sort(F.array_distinct(F.concat(*[f"__w{i}" for i in range(len(rules))]))))
    found = cross_words_of(written(work.select(id_col, "__n", "__w"), "cross-tokens"), id_col, "__n", "__w", nearest, kinds)
    joined = found.select(id_col, *[join_words(F.col(k)).alias(k) for k in kinds])
    return df.join(joined, id_col, "left").withColumns({k: F.coalesce(k, F.lit("")) for k in kinds})
