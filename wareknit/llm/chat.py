"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one
message with array aggregation, and messages are joined to one text:

    <|im_start|>role
    text<|im_sep|>text of the next turn of the same role<|im_end|>
    <|im_start|>...

Control strings that stand in a text are told from the template's by a backslash after their first character; each
one there already gets one more, so that taking one away gives the text back. The loss mask is kept as the list of
the template's pieces with a flag: it covers the texts of assistant turns and nothing else.

Order: by turn, then role, then text (nulls first). Edge cases: a null text or role is an empty one; repeated rows are
turns of their own; an empty table gives an empty result; other columns are not read. A conversation becomes one row
by nature, so that its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The template's control strings and those of common tokenizers, each from "<" or "[" on.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def escaped_role(role: Column) -> Column:
    """Without line feeds, which end a role in the template."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """id_col, formatted string, pieces array<struct<text, loss>>: the pieces joined are the formatted text."""
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    sorted_turns = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    t = F.col("turns")
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))
    runs = sorted_turns.withColumn("starts", starts)
    s = F.col("starts")

    def message(at: Column, k: Column) -> Column:
        upto = F.coalesce(F.get(s, k + 1), F.size(t))
        own = F.slice(t, at + 1, upto - at)
        return F.struct(F.get(t, at)["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts"))

    messages = runs.select(id_col, F.transform(s, message).alias("messages"))

    def pieces(m: Column) -> Column:
        loss = m["role"] == F.lit(loss_role)
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        head = F.array(piece(F.concat(F.lit(START), escaped_role(m["role"]), F.lit("\n")), F.lit(False)))
        body = F.flatten(F.transform(m["texts"], lambda x, i: F.array(piece(F.when(i == 0, "").otherwise(JOIN), F.lit(False)), piece(escaped(x), loss))))
        return F.concat(head, body, F.array(piece(F.lit(END + "\n"), F.lit(False))))

    out = messages.select(id_col, F.flatten(F.transform("messages", pieces)).alias("pieces"))
    out = out.withColumn("pieces", F.filter("pieces", lambda p: (p["text"] != "") | p["loss"]))
    return out.select(id_col, F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, read back from a formatted text."""
    messages = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1_000_000_000)

    def turns(m: Column) -> Column:
        role = unescaped_role(F.substring_index(m, "\n", 1))
        body = F.substring(m, F.length(F.substring_index(m, "\n", 1)) + 2, F.length(m))
        texts = F.split(F.substring_index(body, END, 1), r"<\|im_sep\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")
