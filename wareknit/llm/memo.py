"""What a worker remembers of words: bounded by bytes, for short words only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

#: Bytes that a memo takes, by estimate; an entry takes ENTRY_BYTES beside the characters of its key.
MEMO_BYTES, ENTRY_BYTES = 64_000_000, 180
#: Longer keys are never kept.
LONGEST_KEY = 64
#: A full memo takes no more, and starts anew once it has missed so many lookups for each entry.
MISSES_PER_ENTRY = 8


class Memo:
    def __init__(self, make: Callable[[str], Any], most: int | None = None):
        self.make, self.most = make, MEMO_BYTES if most is None else most
        self.start()

    def start(self) -> None:
        self.known: dict[str, Any] = {}
        self.held = self.missed = 0

    def one(self, key: str) -> Any:
        found = self.known.get(key)
        if found is None:
            found = self.make(key)
            if self.held >= self.most:
                self.missed += 1
                if self.missed > MISSES_PER_ENTRY * len(self.known):
                    self.start()
            elif len(key) <= LONGEST_KEY:
                self.known[key] = found
                self.held += ENTRY_BYTES + len(key)
        return found

    def all(self, keys: Sequence[str]) -> list:
        """What make gives for each key; make never gives None."""
        found = list(map(self.known.get, keys))
        if None in found:
            one = self.one
            for i, x in enumerate(found):
                if x is None:
                    found[i] = one(keys[i])
        return found

    def joined(self, keys: Sequence[str]) -> bytes:
        return b"".join(self.all(keys))
