"""Words and shingles of texts as 64-bit hashes, in numpy, for use within Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers at most; the memory is then emptied.
MEMO_LIMIT = 250_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO_LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every `length` consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = mixed(out) * np.uint64(3) + h[k : k + n] if length <= 4 else out * np.uint64(0x5851F42D4C957F2D) + h[k : k + n]
    return mixed(out)


def shingle_set(text: str | None, length: int = 2) -> np.ndarray:
    """Sorted distinct shingles of the lower-cased (A-Z only) words; the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(length, len(words))))
