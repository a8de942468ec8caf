"""Hashes of all words of a buffer at once.

A word's hash is the sum of T[byte] * R**place over its bytes, taken from one running sum of the
buffer and shifted back to place 0 by a power of R's inverse (R is odd, so it has one modulo 2**64).
"""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(1, 2**64, 256, np.uint64)
#: Bytes of white space: fixed by the contracts.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A second hash, by another R and another table, for those to whom 64 bits are too few.
_R2, _TABLE2 = 0xD1342543DE82EF95, np.random.default_rng(21).integers(1, 2**64, 256, np.uint64)
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in range(2)]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i below n."""
    own = _powers[which]
    if len(own[0]) < n:
        n, r = max(n, 2 * len(own[0])), (_R, _R2)[which]
        for k, base in enumerate((r, pow(r, -1, 2**64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            own[k] = np.cumprod(x)
    return own[0], own[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the longest stretches that are not apart."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], apart, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def running(buf: np.ndarray, which: int = 0) -> np.ndarray:
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_TABLE, _TABLE2)[which][buf] * powers(len(buf), which)[0][: len(buf)], out=total[1:])
    return total


def hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = running(buf)
    return mixed((total[ends] - total[begins]) * powers(len(buf) + 1)[1][begins])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the number of words of each text."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    begins, ends = runs(SPACE[buf])
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(begins, stops)
    return hashes(buf, begins, ends), np.diff(np.concatenate(([0], upto)))
