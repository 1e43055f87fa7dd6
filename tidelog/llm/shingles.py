"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums P and inverse powers: the bytes [i, j) hash to (P[j] - P[i]) * down[i]."""
    up, down = POWERS.reach(raw.size + 1)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: raw.size], out=sums[1:])
    return sums, down


def shingles(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, the place where each text's begin, and each text's words.

    A text of fewer than ``window`` words is one shingle; one without words has none.
    """
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    solid = ~BLANK[raw]
    before = np.concatenate([[False], solid[:-1]]) if raw.size else solid
    starts = np.flatnonzero(solid & ~before)
    stops = np.flatnonzero(~solid & before)
    sums, down = prefix_sums(raw)
    words = mix((sums[stops] - sums[starts]) * down[starts])
    at = np.searchsorted(starts, first)
    count = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(words.size) - at[owner]
    n = np.where(count >= window, count - window + 1, np.minimum(count, 1))
    begins = place < n[owner]
    total = np.zeros(int(n.sum()), np.uint64)
    own, where = owner[begins], np.flatnonzero(begins)
    padded = np.concatenate([words, np.zeros(window, np.uint64)])
    for i in range(window):
        inside = i < np.minimum(count[own], window)
        multiplier = np.uint64((2 * i + 3) * _BASE & (1 << 64) - 1 | 1)
        total += np.where(inside, padded[where + i] * multiplier + np.uint64(i + 1), np.uint64(0))
    return mix(total), np.concatenate([[0], np.cumsum(n)]), count
