"""Vectorised 64-bit hashing of byte runs."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
KEPT = 1 << 22
_TABLES: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling; up to KEPT of them stay for the next call."""
    out = _TABLES.get(base)
    if out is None or len(out) < n:
        out = np.ones(max(n, 1 << 16), dtype=np.uint64)
        have = 1
        while have < len(out):
            more = min(have, len(out) - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        if len(out) <= KEPT:
            _TABLES[base] = out
    return out[:n]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start[i]:end[i]] for every i: differences of one running polynomial sum, scaled to position 0."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=total[1:])
    return mix64((total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start])
