"""Words, word hashes and word n-grams of whole Arrow columns at once, in numpy."""

from __future__ import annotations

import numpy as np

#: [^\x20\x09-\x0D]+ are words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[start:end] for each pair; equal contents get equal hashes wherever they stand."""
    p, q = _power_tables(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[: len(units)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of all texts, and for each text the place of its first word (n + 1 numbers)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    final = word.copy()
    final[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m neighbouring word hashes; it takes no notice of where texts end."""
    n = max(len(words) - m + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(m):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n]
    return mix(h)
