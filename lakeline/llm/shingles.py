"""Words and word shingles of byte texts as 64-bit numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a task remembers.
REMEMBERED = 1 << 20


class WordHashes(dict):
    """Hash of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased.

    ``bytes`` methods know ASCII letters and these very blanks only.
    """
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words; fewer words are one run, none are none."""
    if not len(words):
        return words
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        value = value * MIX + words[i : len(words) - width + 1 + i]
        value ^= value >> np.uint64(29)
    return finish(value)


def shingle_set(text: bytes, size: int, known: WordHashes) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(word_hashes(text, known), size))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sets that are not empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def universal_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``count`` multiply-shift hashes of 64 to 32 bits."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, count, np.uint64)
    return a, b


def minima(values: np.ndarray, family: tuple[np.ndarray, np.ndarray], step: int = 4096) -> np.ndarray:
    """The least hash of the values under each member of the family, as 32 bits."""
    a, b = (x[:, None] for x in family)
    least = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(values), step):
        hashed = (a * values[None, i : i + step] + b) >> np.uint64(32)
        np.minimum(least, hashed.min(axis=1).astype(np.uint32), out=least)
    return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` minima; equal keys in other bands differ."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    value = np.arange(1, len(bands) + 1, dtype=np.uint64) * MIX
    for column in bands.T:
        value = finish(value + column * MIX)
    return value


def digest(values: Sequence[int] | np.ndarray) -> bytes:
    """128 bits that stand for a sorted set of numbers."""
    return xxhash.xxh3_128_digest(np.ascontiguousarray(values, np.uint64).tobytes())
