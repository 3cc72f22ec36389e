"""Words and shingle fingerprints of one text (small helpers that run inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x = x ^ (x >> np.uint64(29))
    x = x * _C2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to ``limit`` words; then it starts anew."""

    def __init__(self, limit: int = 32_768) -> None:
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_stream(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """64-bit fingerprints of the ``k``-word shingles in text order; fewer words give one, no words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _MUL + h[i : len(h) - k + 1 + i]
    return mix64(out + np.uint64(k))


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The distinct fingerprints, ascending."""
    return np.unique(shingle_stream(text, k, hashes))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for ascending distinct arrays that aren't both empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)
