"""Word shingles and MinHash signatures with numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: Odd multipliers of the shingle hash (fixed, arbitrary).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
CACHE = 300_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the common ones."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of fewer words, one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mixed(h * MIX[i % len(MIX)] + words[i : n - width + 1 + i])
    return np.unique(h)


def permutations(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, (k, 1), np.uint64)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set that is not empty, 64 bits each."""
    out = np.full(len(a), MASK, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(out, (items[None, at : at + 2048] * a + b).min(axis=1), out=out)
    return out


def set_key(items: np.ndarray) -> str:
    """Equal for equal sets: their size and 128 bits of their elements."""
    return f"{len(items)}-{xxhash.xxh3_128_hexdigest(items.tobytes())}"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()
