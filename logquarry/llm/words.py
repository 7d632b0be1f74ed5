"""Words of UTF-8 texts and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers at once.
REMEMBERED = 400_000


class WordHashes(dict):
    """bytes -> unsigned 64-bit hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(raw: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased and nothing else."""
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ordered pairs of hashes."""
    return mixed(mixed(a) + np.uint64(0x9E3779B97F4A7C15) * b + np.uint64(1))
