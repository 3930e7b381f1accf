"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
WORDS_KEPT = 200_000  # word hashes a task remembers


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * P3
    x = (x ^ (x >> np.uint64(29))) * P1
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of the whole sequence with fewer words; nothing without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    s = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        s = mixed(s * P2 + hashes[j:n - width + 1 + j])
    return np.unique(s)


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minhash(s: np.ndarray, perms: tuple[np.ndarray, np.ndarray], bits: int = 16, block: int = 8192) -> np.ndarray:
    """The low ``bits`` of a mix of each permutation's least value; for a set that is not empty."""
    a, b = perms
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), block):
        least = np.minimum(least, (s[i:i + block, None] * a + b).min(axis=0))
    return mixed(least) & np.uint64((1 << bits) - 1)
