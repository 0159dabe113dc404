"""Words and word shingles, shared by the operators on word shingles."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; a null text has none."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hash of each word, computed once for as long as it stays in this bounded memory."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles_of(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each run of ``n`` words, in order. A text of fewer words, but one at least, has one shingle of all its words."""
    k = min(n, len(hashes))
    if k == 0:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        out *= _MULT
        out += hashes[i : len(hashes) - k + 1 + i]
    return mix(out)
