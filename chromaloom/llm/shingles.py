"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from chromaloom.llm.bloom import mix

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class WordHashes(dict):
    """word -> 64-bit hash, kept for the frequent words of a task; bounded."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str) -> list[bytes]:
    """Words of ASCII white space, A-Z lower-cased (bytes know no other)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from the hashes of the words."""
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += mix(h[i : i + n] * _ODD[i % 5] + np.uint64(i))
    return mix(total)


def shingle_set(text: str, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words make one shingle."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    return np.unique(gram_hashes(h, size))
