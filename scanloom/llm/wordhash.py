"""Words and their 64-bit hashes, in Python tasks."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Distinct words whose hashes are remembered at once.
REMEMBERED = 300_000


class WordHashes(dict):
    """Hash by word. It forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    found = mixed(hashes[:n] + M1)
    for j in range(1, size):
        found = mixed(found * M1 + hashes[j : j + n])
    return found
