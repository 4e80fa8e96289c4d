"""64-bit hashes of a text's words, vectorised over its bytes."""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers[kind]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash for each word; words hold no space and aren't empty."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * _power("up", BASE, len(raw)))])
    return mix64((sums[ends] - sums[starts]) * _power("down", INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span ``values[start:end]`` of code points or bytes; equal spans hash alike wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * _power("up", BASE, len(values)))])
    return mix64((sums[ends] - sums[starts]) * _power("down", INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))
