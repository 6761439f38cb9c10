"""Words and word shingles as 64-bit hashes, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place of a window.
_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; the cache is emptied at ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` values, in order; empty when there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n] * _ODD[0]
    for j in range(1, width):
        acc = acc + h[j : n + j] * _ODD[j]
    return mix(acc)


def shingle_set(cache: WordHashes, text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text.

    Words are runs of bytes other than ASCII space, tab, line feed, vertical tab, form feed and carriage return, with
    A-Z in lower case. With fewer words than ``width``, the whole sequence counts as one shingle; without words, none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    if len(words) < width:
        return mix((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    return np.unique(windows(h, width))
