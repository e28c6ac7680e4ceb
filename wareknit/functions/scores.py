"""Vectorised helpers for scores and stems that built-in expressions don't have. They are applied to distinct values."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; rows of the table are bits of an integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """200 * common / (both lengths); 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def best_substring(a: str, b: str) -> float:
    """The best similarity of the shorter text with a stretch of the longer one: as long as itself, or cut off at an end.

    While the stretch slides along, the letters that it shares with the shorter text, each as often as both have it, are
    counted: no more can be in common, so that a stretch is compared only where that beats the best so far.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    n, size = len(short), len(long)
    missing = Counter(short)  # how many more of each letter would be shared; below zero: there are too many
    shared, best = 0, 0.0
    for start in range(1 - n, size):
        end = start + n
        if end <= size:
            ch = long[end - 1]
            if ch in missing:
                shared += missing[ch] > 0
                missing[ch] -= 1
        if start > 0:
            ch = long[start - 1]
            if ch in missing:
                missing[ch] += 1
                shared -= missing[ch] > 0
        if 200.0 * shared / (n + min(end, size) - max(0, start)) > best:
            best = max(best, similarity(short, long[max(0, start) : end]))
            if best == 100:
                break
    return best


def token_score(a: str, b: str) -> int:
    """Similarity of two one-word tokens from 0 to 100: whole, or a share of the best substring's if lengths differ."""
    whole = round(similarity(a, b))
    if not a or not b:
        return whole
    length = max(len(a), len(b)) / min(len(a), len(b))
    if length < 1.5:
        return whole
    return max(whole, round((0.9 if length <= 8 else 0.6) * best_substring(a, b)))


def _pairs(f):
    @F.arrow_udf("int")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else round(f(a, b)) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    return score


def token_similarity(left: Column, right: Column) -> Column:
    return _pairs(token_score)(left, right)


def partial_ratio(word: Column, text: Column) -> Column:
    return _pairs(best_substring)(word, text)


# Stems after the published Snowball algorithms (English: Porter2; Russian).
V = "aeiouy"
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int, vowels: str = V) -> int:
    """After the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in V and w[1] not in V
    return len(w) > 2 and w[-1] not in V + "wxY" and w[-2] in V and w[-3] not in V


def stem_english(word: str) -> str:
    w = word.lower().replace("’", "'").removeprefix("'")
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for s, to in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + to
            break
    for s, to in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Fixed values of the published algorithm: endings by kind; those of the first groups follow а or я.
GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
REFLEXIVE = ("ся", "сь")
VERB = (("ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"), ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"))
NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ях", "ах", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")


def _cut(w: str, rv: int, plain: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """Without the longest ending inside the region; None if there is none."""
    for s in sorted({*plain, *after_a}, key=len, reverse=True):
        if w.endswith(s) and len(w) - len(s) >= rv:
            if s in plain or (len(w) - len(s) > rv and w[-len(s) - 1] in "ая"):
                return w[: -len(s)]
            if s in after_a:
                return None
    return None


def stem_russian(word: str) -> str:
    vowels = "аеиоуыэюя"
    w = word.lower().replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in vowels), len(w))
    r2 = _region(w, _region(w, 0, vowels), vowels)
    got = _cut(w, rv, GERUND[1], GERUND[0])
    if got is not None:
        w = got
    else:
        got = _cut(w, rv, REFLEXIVE)
        w = w if got is None else got
        got = _cut(w, rv, ADJECTIVE)
        if got is not None:
            w = got
            got = _cut(w, rv, PARTICIPLE[1], PARTICIPLE[0])
            w = w if got is None else got
        else:
            got = _cut(w, rv, VERB[1], VERB[0])
            if got is None:
                got = _cut(w, rv, NOUN)
            w = w if got is None else got
    if w.endswith("и") and len(w) > rv:
        w = w[:-1]
    for s in ("ость", "ост"):
        if w.endswith(s) and len(w) - len(s) >= r2:
            w = w[: -len(s)]
            break
    if w.endswith("нн") and len(w) - 1 > rv:
        return w[:-1]
    for s in ("ейше", "ейш"):
        if w.endswith(s) and len(w) - len(s) >= rv:
            w = w[: -len(s)]
            return w[:-1] if w.endswith("нн") else w
    return w[:-1] if w.endswith("ь") and len(w) > rv else w


STEMMERS = {"english": stem_english, "russian": stem_russian}


def stem(word: Column, language: str) -> Column:
    f = STEMMERS[language]

    @F.arrow_udf("string")
    def stems(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else f(w) for w in words.to_pylist()], pa.string())

    return stems(word)
