"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
WORD_CACHE = 150_000


class Hashes(dict):
    """Hashes of words; short ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def joined(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` words in a row."""
    places = len(words) - size + 1
    mixed = np.full(places, size, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i:i + places]) * _MULTIPLIER
        mixed ^= mixed >> _SHIFT
    return mixed


class Shingler:
    """Distinct shingles of ``words`` words; a shorter text is one shingle, no word none.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, which is
    what ``bytes.lower`` and ``bytes.split`` do on UTF-8.
    """

    def __init__(self, words: int):
        self.words = words
        self.known = Hashes()

    def hashes(self, text: str | None) -> np.ndarray:
        return self.word_hashes((text or "").encode().lower().split())

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = self.hashes(text)
        size = min(self.words, len(words))
        return np.unique(joined(words, size)) if size else words


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * |a & b| >= percent * |a | b|`` for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = len(np.intersect1d(small, large, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
