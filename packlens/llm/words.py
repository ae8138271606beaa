"""Hashes of words, remembered by each Python worker for all operators together, within a bound."""

from __future__ import annotations

import xxhash

#: Words remembered at most; then all are forgotten.
MAX_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = _Hashes()
