"""Words and tokens of names: column functions of built-in expressions, and a stemmer over distinct words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a language.
LETTERS = {"english": "a-z", "russian": "а-яё"}
UPPER = {"english": "A-Z", "russian": "А-ЯЁ"}


@dataclass(frozen=True)
class WordRule:
    """What counts as a word: language, letter case ("any", "capital" or "caps"), digits and symbols, boundaries."""

    language: str = "english"
    case: str = "any"
    with_numbers: bool = False
    symbols: str = ""
    word_boundary: bool = True
    custom_boundary: str = ""
    check_letters: bool = False
    min_length: int = 1
    max_words: int = 0
    stem: bool = False

    @property
    def letters(self) -> str:
        return LETTERS[self.language]

    @property
    def pattern(self) -> str:
        """One word, without boundaries. Symbols may not come first."""
        digits = "0-9" if self.with_numbers else ""
        low, up = LETTERS[self.language], UPPER[self.language]
        first = (up if self.case in ("capital", "caps") else up + low) + digits
        rest = (up if self.case == "caps" else up + low) + digits + self.symbols
        return f"[{first}][{rest}]*"

    @property
    def bounded(self) -> str:
        if self.custom_boundary:
            return f"(?U)(?:{self.custom_boundary})({self.pattern})(?:{self.custom_boundary})"
        if self.word_boundary:
            return rf"(?U)\b({self.pattern})\b"
        return f"({self.pattern})"


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def extract_words(col: str | Column, rule: WordRule) -> Column:
    """The words of a rule in text order; letter-less ones only if the rule doesn't ask for letters."""
    words = F.regexp_extract_all(text_of(col), F.lit(rule.bounded), 1)
    if rule.check_letters:
        words = F.filter(words, lambda w: F.lower(w).rlike(f"[{rule.letters}]"))
    return F.transform(words, lambda w: F.trim(w))


def delete_words(col: str | Column, rule: WordRule) -> Column:
    """The text without the rule's words; what is left has single spaces."""
    return F.regexp_replace(F.regexp_replace(text_of(col), rule.bounded, " "), " +", " ")


def extract_words_multi(col: str | Column, rules: list[WordRule], main: int = 0) -> Column:
    """The words of several rules in text order; kept and cut as the main rule says."""
    each = "|".join(r.bounded.replace("(?U)", "").replace("(" + r.pattern + ")", r.pattern) for r in rules)
    words = F.transform(F.regexp_extract_all(text_of(col), F.lit("(?U)" + each), 0), lambda w: F.trim(w))
    return filter_words(words, rules[main].min_length, rules[main].max_words)


def filter_words(words: Column, min_length: int, max_words: int = 0) -> Column:
    kept = F.filter(words, lambda w: F.length(w) >= min_length)
    return F.slice(kept, 1, max_words) if max_words else kept


def join_words(words: Column, joiner: str = "|") -> Column:
    return F.array_join(words, joiner)


def simple_tokens(col: str | Column, symbols: str = "-") -> Column:
    """Lower-case tokens of two or more letters, digits and symbols, each once, in order."""
    rest = "".join("\\" + s if not s.isalnum() else s for s in symbols)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_of(col)), F.lit(f"[а-яa-z0-9][а-яa-z0-9{rest}]+"), 0)))


def rule_tokens(col: str | Column, rules: list[WordRule]) -> Column:
    """The lower-case words of all rules, each once, sorted."""
    words = [filter_words(extract_words(col, r), r.min_length, r.max_words) for r in rules]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*words), lambda w: F.lower(w))))
