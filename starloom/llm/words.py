"""Words and shingles of texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MOST_CACHED = 100_000  # words a worker remembers before it starts anew; some 20 MB


class WordHashes(dict):
    """Hash of each word (bytes), remembered; forgets everything when it has grown to ``MOST_CACHED``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width_here = min(width, n)
    out = np.full(n - width_here + 1, np.uint64(width_here))
    for i in range(width_here):
        out = mix(out + hashes[i : n - width_here + 1 + i])
    return out
