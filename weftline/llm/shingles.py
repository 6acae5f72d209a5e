"""Word shingles as 64-bit numbers, and numbers that stand for whole sets. Pure NumPy, used inside Arrow functions."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes A-Z in lower case; other bytes, also those of UTF-8 sequences, as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers of words, remembered for the most recent ones."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of some words, in order."""
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """The shingle that begins at each word: a polynomial of the words' numbers, scrambled once."""
    n = len(ids) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * STEP + ids[j : j + n]
    return mix(h)


def shingle_set(words: list[bytes], size: int, memory: Words) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; fewer words are one shingle; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingles(memory.numbers(words), min(size, len(words))))


def set_key(items: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit number for the whole set."""
    n = xxhash.xxh3_64_intdigest(items.tobytes(), seed)
    return n - (1 << 64) if n >> 63 else n


class Seen:
    """Recently seen keys of one task: what repeats within a task is sent on once. Forgetting only costs repeats."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.keys = most, set()

    def __call__(self, key: int) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return False
