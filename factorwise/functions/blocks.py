"""Matching blocks of many pairs of short texts at once, in arrays.

The similarity of Ratcliff and Obershelp counts the characters in matching blocks: the longest common block (the first
in the left text, then in the right one, among equals), then the same to its left and to its right. Here all open stretches
of all pairs are one batch. A round finds the longest block of every stretch by one sweep over the left
characters, with the lengths of common runs kept per right position, and puts the stretches beside the blocks into the
next round. Rounds are as many as blocks lie within each other, not as many as there are pairs.

In right texts of 200 characters and more, characters that make up over a hundredth of the text start no block, but extend one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells (stretches * right positions) swept together.
CELLS = 1 << 21
# Fixed value: from this length of the right text on, frequent characters start no block.
LONG = 200


def _codes(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, sizes.max(initial=0))), pad, np.int64)
    inside = np.arange(out.shape[1]) < sizes[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, sizes


def _without_frequent(b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = b.copy()
    for row in np.flatnonzero(sizes >= LONG):
        codes, n = np.unique(b[row, : sizes[row]], return_counts=True)
        out[row, np.isin(b[row], codes[n > sizes[row] // 100 + 1])] = -3
    return out


def _sweep(lefts: Sequence[str], rights: Sequence[str]) -> np.ndarray:
    a, a_size = _codes(lefts, -1)
    b, b_size = _codes(rights, -2)
    starts = _without_frequent(b, b_size) if (b_size >= LONG).any() else b
    pair = np.arange(len(lefts))
    a_from, a_to, b_from, b_to = np.zeros_like(pair), a_size.copy(), np.zeros_like(pair), b_size.copy()
    total = np.zeros(len(lefts), np.int64)
    while len(pair):
        at = b_from[:, None] + np.arange((b_to - b_from).max(initial=0))
        right = np.where(at < b_to[:, None], starts[pair[:, None], np.minimum(at, b.shape[1] - 1)], -2)
        run = np.zeros(right.shape, np.int64)
        size, i0, j0 = np.zeros_like(pair), a_from.copy(), b_from.copy()
        for i in range((a_to - a_from).max(initial=0)):
            here = a_from + i
            char = np.where(here < a_to, a[pair, np.minimum(here, a.shape[1] - 1)], -1)
            longer = np.zeros_like(run)
            longer[:, 1:] = run[:, :-1]
            run = np.where(right == char[:, None], longer + 1, 0)
            end = run.argmax(1)
            most = run[np.arange(len(run)), end]
            better = most > size
            size[better] = most[better]
            i0[better], j0[better] = (here - most + 1)[better], (b_from + end - most + 1)[better]
        if starts is not b:
            while (back := (i0 > a_from) & (j0 > b_from) & (a[pair, i0 - 1] == b[pair, j0 - 1])).any():
                i0[back], j0[back], size[back] = i0[back] - 1, j0[back] - 1, size[back] + 1
            while True:
                i1, j1 = i0 + size, j0 + size
                on = (i1 < a_to) & (j1 < b_to) & (a[pair, np.minimum(i1, a.shape[1] - 1)] == b[pair, np.minimum(j1, b.shape[1] - 1)])
                if not on.any():
                    break
                size[on] += 1
        np.add.at(total, pair, size)
        i1, j1 = i0 + size, j0 + size
        before, after = (size > 0) & (i0 > a_from) & (j0 > b_from), (size > 0) & (i1 < a_to) & (j1 < b_to)
        pair, a_from, a_to, b_from, b_to = (
            np.concatenate((x[before], y[after]))
            for x, y in ((pair, pair), (a_from, i1), (i0, a_to), (b_from, j1), (j0, b_to))
        )
    return total


def matching_characters(lefts: Sequence[str], rights: Sequence[str]) -> np.ndarray:
    """Characters in matching blocks of each pair of texts."""
    total = np.zeros(len(lefts), np.int64)
    order = sorted(range(len(lefts)), key=lambda i: (len(rights[i]), len(lefts[i])))
    begin = 0
    while begin < len(order):  # the longest text of a chunk sets its width; a single pair may exceed it
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * (len(rights[order[end]]) + 1) <= CELLS:
            end += 1
        chunk = order[begin:end]
        total[chunk] = _sweep([lefts[i] for i in chunk], [rights[i] for i in chunk])
        begin = end
    return total


def similarity(lefts: Sequence[str], rights: Sequence[str]) -> np.ndarray:
    """Twice the matching characters over all characters; 1 for two empty texts."""
    sizes = np.array([len(a) + len(b) for a, b in zip(lefts, rights)], np.float64)
    return np.where(sizes > 0, 2.0 * matching_characters(lefts, rights) / np.maximum(sizes, 1), 1.0)
