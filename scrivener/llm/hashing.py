"""Polynomial hashes of byte strings modulo 2^64, vectorised over all places of a text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes for which powers are made at once.
STEP = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: For hashes that don't depend on the first ones.
OTHER_BASE = 0xD1342543DE82EF95


class Powers:
    """Powers of a base and of its inverse modulo 2^64, and what stands for the bytes."""

    def __init__(self, base: int = _BASE):
        self.base, self.symbol = base, SYMBOL if base == _BASE else mix(SYMBOL ^ np.uint64(base))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, STEP + 1)
            run = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))])
            self.up, self.down = run(np.uint64(self.base)), run(np.uint64(pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class Hashed:
    """Hashes of any substring of data; equal strings have equal hashes wherever they lie."""

    def __init__(self, data: bytes, powers: Powers):
        self.bytes = np.frombuffer(data, np.uint8)
        up, self.down = powers.of(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(powers.symbol[self.bytes] * up[:-1], out=self.total[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, n: int) -> np.ndarray:
        """Of all substrings of n bytes, in order."""
        return mix((self.total[n:] - self.total[: len(self.total) - n]) * self.down[: len(self.total) - n])


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    turn = np.diff(space)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of data."""
    hashed = Hashed(data, powers)
    starts, ends = word_bounds(hashed.bytes)
    return hashed.at(starts, ends), starts
