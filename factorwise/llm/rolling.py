"""Hashes of ranges of an array, all ranges at once."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of true values."""
    step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        step = np.concatenate(([0], step))
    if len(inside) and inside[-1]:
        step = np.append(step, len(inside))
    return step[0::2], step[1::2]


class Ranges:
    """Polynomial prefix sums of ``values``: the hash of any range costs two look-ups."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = _powers(1 << max(10, len(values).bit_length()))
        terms = values.astype(np.uint64) + np.uint64(1)
        terms *= up[: len(values)]
        self._total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._total[end] - self._total[start]) * self._down[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of each range of ``width`` values."""
        n = len(self._total) - width
        return mixed((self._total[width:] - self._total[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
