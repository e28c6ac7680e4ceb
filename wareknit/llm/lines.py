"""Line dedup: lines that many documents share are dropped everywhere.

Every text is split at line feeds, and each line's key (without ASCII white space at its ends, A-Z lower-cased) is
hashed to 128 bits. The hashes are written once, with the row and the place they come from and without the lines
themselves. Distinct documents are counted for each hash, the places of frequent ones are gathered for each row, and a
text is put together again from the places that are left. The text itself moves once, where it meets its places.

A frequent line is a hot key: it is counted over distinct (hash, document) rows, which are summed in each partition
before they move, and both the frequent hashes and the dropped places are written, so that Spark can split their joins.

Edge cases: a null or empty text is one empty line; an empty key is never dropped; a text that loses all its lines is
empty; rows of one id are one document (so are all rows without an id), and each has its own result; a line that is
repeated in one document counts once; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved, whole_text

LEAST_DOCUMENTS = 10
#: What is stripped from the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    stripped = F.trim(line, F.lit(BLANKS))
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest, place, h1, h2: the 128-bit hash of each line's key, but of empty ones, and where it stands."""
    text = whole_text(text_col)
    keys = F.posexplode(F.transform(lines_of(text), key_of)).alias("place", "key")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), keys).filter(F.col("key") != "")
    return rows.select("id", "digest", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def frequent_hashes(hashes: DataFrame, least: int) -> DataFrame:
    """h1, h2 of the keys in so many documents or more."""
    counted = hashes.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("documents"))
    return counted.filter(F.col("documents") >= least).select("h1", "h2")


def kept_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the dropped places."""
    lines = lines_of(text)
    # An array of one struct holds the lines, so that they are split once for all places.
    both = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped).alias("places")))
    joined = F.transform(both, lambda b: F.array_join(F.transform(b["places"], lambda k: F.get(b["lines"], k)), "\n"))
    return F.when(dropped.isNull(), text).otherwise(F.get(joined, 0))


def drop_frequent_lines(docs: DataFrame, name: str, least: int = LEAST_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column name: struct<n_lines long, n_dropped long, kept string>."""
    hashes = saved(line_hashes(docs, id_col, text_col), "line-hashes")
    frequent = saved(frequent_hashes(hashes, least), "frequent-lines")
    own_id, digest, places = (free_name(docs, n) for n in ("row_id", "row_digest", "row_places"))
    dropped = hashes.join(frequent, ["h1", "h2"], "left_semi").groupBy("id", "digest").agg(F.collect_set("place").alias(places))
    dropped = saved(dropped.select(F.col("id").alias(own_id), F.col("digest").alias(digest), places), "dropped-places")
    text = whole_text(text_col)
    same_row = docs[id_col].eqNullSafe(dropped[own_id]) & (F.xxhash64(text) == dropped[digest])
    found = docs.join(dropped, same_row, "left")
    gone = F.coalesce(F.size(F.col(places)), F.lit(0)).cast("long")
    whole = F.struct(F.size(lines_of(text)).cast("long").alias("n_lines"), gone.alias("n_dropped"), kept_lines(text, F.col(places)).alias("kept"))
    return found.withColumn(name, whole).select(*docs.columns, name)
