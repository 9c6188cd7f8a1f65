"""Matching blocks of many pairs of strings at once: the longest common block, then what lies left and right of it.

All pairs of a batch go through the levels of that recursion together.  At each level every open region of every
pair is one row of a table, and the longest common block of all rows is found by one step a character of the first string:
run lengths along the diagonals, of equal lengths the first by place in the first string, then in the second.

Characters of the second string that are popular (more than one in a hundred, of 200 or more) may be left out, as
difflib does by default: no block begins from them, but blocks are extended over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of a table of regions at once.
CELLS = 1 << 22
POPULAR_FROM = 200


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text begins, with the end."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return joined, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _popular(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which code points stand too often in their text."""
    out = np.zeros(len(codes), bool)
    for i in np.flatnonzero(np.diff(at) >= POPULAR_FROM):
        own = codes[at[i] : at[i + 1]]
        _, place, n = np.unique(own, return_inverse=True, return_counts=True)
        out[at[i] : at[i + 1]] = (n > len(own) // 100 + 1)[place]
    return out


def _longest(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, region: np.ndarray) -> np.ndarray:
    """(begin in a, begin in b, length) of each region's longest block; regions are (a from, a to, b from, b to) in all code points."""
    n, m = region[:, 1] - region[:, 0], region[:, 3] - region[:, 2]
    rows, columns = np.arange(len(region)), np.arange(int(m.max()))
    at_b = np.minimum(region[:, 2, None] + columns, len(b) - 1)
    inside = columns < m[:, None]
    right = np.where(inside & seeds[at_b], b[at_b], -1)
    run = np.zeros((len(region), len(columns) + 1), np.int32)
    best = np.column_stack([region[:, 0], region[:, 2], np.zeros(len(region), np.int64)])
    for i in range(int(n.max())):
        here = np.where(i < n, a[np.minimum(region[:, 0] + i, len(a) - 1)], -2)
        run[:, 1:] = np.where(right == here[:, None], run[:, :-1] + 1, 0)
        j = run[:, 1:].argmax(1)
        length = run[rows, j + 1]
        more = length > best[:, 2]
        best[more] = np.column_stack([region[:, 0] + i + 1 - length, region[:, 2] + j + 1 - length, length])[more]
    return best


def _extended(a: np.ndarray, b: np.ndarray, region: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Blocks grown to both sides over equal code points, whether they may begin a block or not."""
    for side in (-1, 1):
        open_ = np.arange(len(best))
        while len(open_):
            i, j, k = best[open_].T
            at_a, at_b = (i - 1, j - 1) if side < 0 else (i + k, j + k)
            fits = (at_a >= region[open_, 0]) & (at_b >= region[open_, 2]) & (at_a < region[open_, 1]) & (at_b < region[open_, 3])
            fits[fits] = a[at_a[fits]] == b[at_b[fits]]
            open_ = open_[fits]
            best[open_, 2] += 1
            if side < 0:
                best[open_, :2] -= 1
    return best


def matched(first: Sequence[str], second: Sequence[str], popular: bool = False) -> np.ndarray:
    """How many code points the matching blocks of each pair have; with popular, popular ones are left out."""
    (a, at_a), (b, at_b) = _codes(first), _codes(second)
    total = np.zeros(len(first), np.int64)
    seeds = ~_popular(b, at_b) if popular else np.ones(len(b), bool)
    owner = np.arange(len(first))
    region = np.column_stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]])
    while True:
        full = (region[:, 0] < region[:, 1]) & (region[:, 2] < region[:, 3])
        owner, region = owner[full], region[full]
        if not len(region):
            return total
        # regions of like size share a table
        order = np.argsort((region[:, 3] - region[:, 2]) + (region[:, 1] - region[:, 0]), kind="stable")
        owner, region = owner[order], region[order]
        found, begin = [], 0
        widths = np.maximum.accumulate(region[:, 3] - region[:, 2])
        while begin < len(region):
            end = begin + max(1, int(np.searchsorted(widths[begin:] * np.arange(1, len(region) - begin + 1), CELLS, "right")))
            part = region[begin:end]
            best = _longest(a, b, seeds, part)
            found.append(_extended(a, b, part, best) if popular else best)
            begin = end
        best = np.concatenate(found)
        np.add.at(total, owner, best[:, 2])
        hit = best[:, 2] > 0
        owner, region, (i, j, k) = owner[hit], region[hit], best[hit].T
        left = np.column_stack([region[:, 0], i, region[:, 2], j])
        right = np.column_stack([i + k, region[:, 1], j + k, region[:, 3]])
        owner, region = np.concatenate([owner, owner]), np.concatenate([left, right])


def ratios(first: Sequence[str], second: Sequence[str], popular: bool = False) -> np.ndarray:
    """Twice the matched code points over both lengths; 1 for two empty strings."""
    sizes = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], np.int64)
    return np.where(sizes > 0, 2.0 * matched(first, second, popular) / np.maximum(sizes, 1), 1.0)
