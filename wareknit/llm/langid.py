"""Language identification by rank-order profiles of n-grams.

A language's profile is the list of its most frequent n-grams (one to three letters of lower-cased words, padded with
a blank on both sides), ranked by frequency over all its training texts. A document's own ranking is compared with
each profile: the out-of-place distance sums how far each of the document's n-grams stands from its place there,
PROFILE for one that isn't there. The nearest language is predicted, the first by name of equally near ones; the score
is 1 - distance / largest possible distance.

N-grams are counted in each input partition and summed by Spark; only profiles (PROFILE n-grams for each language)
come to the driver.

Edge cases: a null text and one without letters (characters of the letter categories; digits, fractions and the like
are none) is `und` with score 0, as is every text if there are no profiles; training rows with null text or language
are left out; ties in frequency are ordered by the n-gram, character by character; repeated rows count each time; a very
long text is counted WINDOW characters at a time, so that a worker holds its different n-grams, not all of them; an empty
table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

PROFILE = 400
#: N-grams that a worker holds before it sums them, and different ones before it hands on its sums.
SUMMED, HELD = 2_000_000, 500_000
BLANK = 32
#: Characters of a text that are looked at together.
WINDOW = 1 << 18


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """All n-grams of the text, WINDOW characters at a time: 21 bits for each character, so that the order of numbers is
    that of n-grams."""
    if "Σ" in text:  # the one letter whose lower case depends on what stands around it
        text = text.lower()
    # A blank stands for what follows a word, and one goes in front of all. The last two go before the next window.
    carry, before = np.array([BLANK], np.uint64), False
    for a in range(0, len(text), WINDOW):
        x = np.frombuffer(text[a : a + WINDOW].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[x]
        kept = letter | np.concatenate([[before], letter[:-1]])
        before = letter[-1]
        new = np.where(letter, x, BLANK)[kept].astype(np.uint64)
        if before and a + WINDOW >= len(text):
            new = np.append(new, np.uint64(BLANK))
        if len(new):
            y, m = np.concatenate([carry, new]), len(carry)
            first, second = y << np.uint64(42), y << np.uint64(21)
            two = (first[:-1] | second[1:])[m - 1 :]
            three = ((first[:-2] | second[1:-1] | y[2:])[max(0, m - 2) :])[y[1:-1][max(0, m - 2) :] != BLANK]
            yield np.concatenate([first[m:][new != BLANK], two, three])
            carry = y[-2:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted numbers, and how often each is there."""
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[firsts], np.diff(np.append(firsts, len(codes)))


def merged(*counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts of sorted numbers."""
    codes, n = (np.concatenate(p) for p in zip(*counts))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[firsts], np.add.reduceat(n, firsts) if len(firsts) else n


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams in their order, and how often each is there."""
    found = None
    for codes in gram_codes(text):
        own = counted(np.sort(codes))
        found = own if found is None else merged(found, own)
    return found or (np.empty(0, np.uint64), np.empty(0, np.int64))


def gram_of(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def code_of(gram: str) -> int:
    return sum(ord(c) << s for c, s in zip(gram, (42, 21, 0)))


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[str, list[np.ndarray]] = {}

        def summed() -> None:
            for lang, own in parts.items():
                found = counted(np.sort(np.concatenate(own)))
                sums[lang] = merged(sums[lang], found) if lang in sums else found
            parts.clear()

        def taken() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array([gram_of(c) for c in codes.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for own in gram_codes(text.as_py()):
                    parts.setdefault(lang.as_py(), []).append(own)
                    held += len(own)
                    if held > SUMMED:
                        summed()
                        held = 0
                        if sum(len(codes) for codes, _ in sums.values()) > HELD:
                            yield from taken()
        summed()
        yield from taken()

    return rows.select("lang", "text").mapInArrow(partial, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    """The ranked n-grams of each language; rows: (lang, text)."""
    rows = rows.select("lang", "text").filter("lang is not null and text is not null")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = gram_counts(rows).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= size)
    profiles: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    def __init__(self, profiles: dict[str, list[str]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.array(sorted({code_of(g) for p in profiles.values() for g in p}), np.uint64)
        # The place of each of these n-grams in each profile; far beyond all for one that isn't there, as in the last column.
        self.places = np.full((len(self.langs), len(self.codes) + 1), 3 * size)
        for row, lang in zip(self.places, self.langs):
            row[np.searchsorted(self.codes, np.array([code_of(g) for g in profiles[lang]], np.uint64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, n = text_counts(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        if len(codes) > self.size:
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            codes, n = codes[n >= least], n[n >= least]
        codes = codes[np.argsort(-n, kind="stable")][: self.size]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at[self.codes[at] != codes] = len(self.codes)
        distance = np.minimum(np.abs(self.places[:, at] - np.arange(len(codes))), self.size).sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], 1 - float(distance[best]) / (self.size * len(codes))


def predicted(text: Column, profiles: dict[str, list[str]], size: int = PROFILE) -> Column:
    """struct<lang string, score double>."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranker = Ranker(profiles, size)
        for (batch,) in slices((b,) for b in batches):
            rows = [ranker.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])

    return predict(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learn_from_documents(docs: DataFrame) -> dict[str, list[str]]:
    """Profiles from the rows that aren't held out."""
    return learn_profiles(docs.filter(~F.coalesce(held_out(), F.lit(False))))
