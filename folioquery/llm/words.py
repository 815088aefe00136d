"""Word splitting and rolling hashes shared by the operators of this package.

Texts are handled as UTF-8 bytes; null counts as empty. Lower-casing touches A-Z
only. Words are the runs of digits, letters and bytes from 0x80 up.
"""

from __future__ import annotations

import sys
import types

import numpy as np

# Every byte that separates words becomes a space, A-Z become a-z, the rest stays.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

# An odd multiplier makes powers invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def fold_words(data: bytes) -> list[bytes]:
    """Lower-cased words of a text."""
    return data.translate(_FOLD).split()


def folded(data: bytes) -> bytes:
    """Lower-cased text of the same length, separators as spaces: offsets stay valid."""
    return data.translate(_FOLD)


def worker_cache() -> dict:
    """What a Python worker keeps between its tasks; functions sent by value have no
    module of their own there."""
    return sys.modules.setdefault("_training_data_cache", types.ModuleType("_training_data_cache")).__dict__


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the multiplier or its inverse, kept between calls."""
    cache = worker_cache()
    have = cache.get(kind, np.ones(1, np.uint64))
    while len(have) < n:
        step = pow(_BASE if kind == "base" else _INVERSE, len(have), 1 << 64)
        have = cache[kind] = np.concatenate([have, have * np.uint64(step)])
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial prefix hashes of one byte string: any range hashes in constant time."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("base", len(raw)), out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of bounds; equal strings hash alike."""
        n = len(self.prefix)
        return mix((self.prefix[end] - self.prefix[start]) * _power("inverse", n)[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every substring of ``width`` bytes."""
        count = len(self.prefix) - width
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:count]) * _power("inverse", count))


def shingles(data: bytes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of ``width`` words, and how often each occurs.

    A text of fewer words, but not none, is one shingle; no words give none.
    """
    words = fold_words(data)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    run = min(width, len(words))
    hashes = Rolling(joined).ranges(starts[: len(words) - run + 1], ends[run - 1 :])
    return np.unique(hashes, return_counts=True)
