"""Words of texts, as numbers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Turns everything of ASCII but letters, digits and line ends into spaces.
_TABLE = bytes(i if i >= 128 or chr(i).isalnum() or i == 10 else 32 for i in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, punctuation as spaces, line ends kept; words of it are what ``split()`` gives."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE)


class Numbers(dict):
    """Word to a 64-bit hash; forgets all when it holds too many."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of a shorter text, one hash of all its words."""
    size = min(size, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)]
    return mixed(out)
