"""Exact ids and counts of a tokenizers .json file, without the library's cost for each text.

The library splits a text into words before it merges inside them. That split is repeated here only for texts of
characters on which all expressions agree (white space, ASCII, Latin letters); any other text, any with a special
token's string and any split pattern not known here goes whole to the library.

Texts of a byte-level vocabulary are split and merged by tiktoken, which takes ranks of tokens instead of a list of
merges. Both are the same where ranks follow the order of the merges and every token, written out, is merged to itself;
a vocabulary that doesn't have these two properties is left to the library. For a lower-casing vocabulary, a worker
keeps the counts of words in a bounded memo.
"""

from __future__ import annotations

import json
import re
from array import array

from .memo import Memo

#: Characters outside this class send a text to the library.
OUTSIDE = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]").search
#: Texts without these have no white space but spaces and line feeds, and nothing that OUTSIDE finds.
UNUSUAL = re.compile("[^\n\x20-\x7e\xa1-ɏ]").search
#: Below U+0250, the numbers that aren't ASCII digits.
ODD_NUMBERS = "²³¹¼½¾"
LETTER, NUMBER = rf"[^\W\d_{ODD_NUMBERS}]", rf"[\d{ODD_NUMBERS}]"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split pattern of the lower-casing vocabulary file, as its library states it.
LOWER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from U+0100.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
LETTER_BYTES = {chr(b): b for b in PRINTABLE} | {c: b for b, c in BYTE_LETTERS.items()}


#: The split pattern of byte-level vocabularies, and what it comes to where white space stands alone.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_SPLIT_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def encoders(vocabulary: dict[str, int], merges: list, model) -> list | None:
    """Functions from a text to its ids, by either split; None if ranks can't stand for the merges of the library's model."""
    import tiktoken

    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:])) or not all(LETTER_BYTES.keys() >= set(t) for t in vocabulary):
        return None
    ranks = {bytes(LETTER_BYTES[c] for c in t): i for t, i in vocabulary.items()}
    if len(made) + 256 != len(ranks) or min(made, default=256) <= max(i for t, i in ranks.items() if len(t) == 1):
        return None
    if not all(len(model.tokenize(t)) == 1 for t in vocabulary):
        return None
    return [tiktoken.Encoding("words", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary for p in (BYTE_SPLIT, BYTE_SPLIT_ALONE)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)) if added else "(?!)").search
        pre, normal = spec["pre_tokenizer"], spec["normalizer"]
        self.encoders, self.words, self.lower = None, None, False
        if normal is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            if {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges") and v} == {"type": "BPE"}:
                self.encoders = encoders(spec["model"]["vocab"], spec["model"]["merges"], self.model)
        elif (normal or {}).get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}] and pre["pretokenizers"][0]["pattern"] == {"Regex": LOWER_SPLIT}:
            # Below U+0250 all texts are in NFC, and white space only divides.
            self.words, self.lower = re.compile(rf"{CONTRACTIONS}|{LETTER}+|{NUMBER}|(?:[^\s\w]|_)+").findall, True
        self.memo = Memo(self.word_ids)
        self.counts = Memo(lambda chunk: len(self.memo.joined(self.words(chunk))) // 4)

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        return array("I", self.id_list(text)).tobytes()

    def id_list(self, text: str) -> list[int]:
        usual = not UNUSUAL(text)
        if self.encoders is None or self.special(text) or not (usual or not OUTSIDE(text)):
            return self.whole(text)
        # Words begin at a space before anything but white space, and on both sides of up to two line feeds.
        alone = usual and "  " not in text and " \n" not in text and "\n\n " not in text and "\n\n\n" not in text and text[-1:] not in (" ", "\n")
        return self.encoders[alone](text)

    def word_ids(self, word: str) -> bytes:
        """Ids of one word of a lower-casing vocabulary, by the library's merges."""
        letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def count(self, text: str) -> int:
        if self.lower and not OUTSIDE(text) and not self.special(text):
            return sum(self.counts.all(text.lower().split()))
        return len(self.id_list(text))


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One for each worker and file."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Bpe(path)
    return _loaded[path]
