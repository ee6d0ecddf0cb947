"""Vectorised polynomial hashes of byte texts, their words and runs of words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
KEPT = 1 << 20  # powers that a worker keeps, at most
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class PrefixHashes:
    """Polynomial hashes of a byte array: any piece's hash from two prefix values."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data) + 1
        if len(PrefixHashes._powers) < n:
            size = max(n, 1 << 16)
            keeper = PrefixHashes if size < KEPT else self  # longer data has its own
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(size + 1, base, np.uint64)
                steps[0] = 1
                setattr(keeper, name, np.cumprod(steps, out=steps))
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * self._powers[: n - 1], out=self.prefix[1:])

    def piece(self, start, length):
        return (self.prefix[start + length] - self.prefix[start]) * self._inverses[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread hashes over all bits, so that their order is random."""
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blank-separated words of all texts, one after another, and the texts' word counts."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = joined == 32
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    h = mixed(PrefixHashes(joined).piece(starts, ends - starts) + (ends - starts).astype(np.uint64))
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return h, np.diff(np.searchsorted(starts, stops), prepend=0)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += h[j : len(h) - k + 1 + j]
    return mixed(out)
