"""Hashes of words and of runs of words, as numpy arrays of 64-bit numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SEED = 42
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """XXH64 of words (texts or bytes), made when first asked for; at most ``kept`` are held."""

    def __init__(self, kept: int = 1 << 19):
        self.kept = kept

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        if len(self) >= self.kept:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"), SEED)
        return h

    def of(self, words: Sequence) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, width: int, start: int) -> np.ndarray:
    """A hash of each run of ``width`` words; runs of no word make one hash of ``start``."""
    n = max(1, len(words) - width + 1) if width <= len(words) else 0
    h = np.full(n, start, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ words[k : k + n]) * STEP
            h ^= h >> np.uint64(32)
        h *= MIX
    return h ^ (h >> np.uint64(31))
