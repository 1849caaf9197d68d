"""Classes of equal strings of a given length, from a Burrows-Wheeler transform.

The suffixes of a text are sorted by their first ``depth`` bytes, which is as much order
as intervals of strings up to that length need. From the transform, intervals of
suffixes that begin with a string w are extended backward to those of cw, breadth
first, so that the length of common prefixes grows by one a level: the first interval
to end at a place gives the common prefix of the two suffixes there. The expansion
stops at ``depth``; places that no interval has ended at then lie within a class of
suffixes that share ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes (at least 8)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k].astype(np.uint64)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after
        have += step


def class_starts(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each begins a class (differs from the one before within ``depth``).

    The byte 254, which the text must not have, is put at its end, and its suffix is one of the result's.
    """
    text = np.append(text, np.uint8(254))
    suffixes = sorted_suffixes(text, depth)
    n = len(text)
    last = text[suffixes - 1]  # the transform; the text is taken as a ring
    to = np.empty(n, np.int64)
    to[np.argsort(last, kind="stable")] = np.arange(n)  # from a row to that of the suffix one byte longer
    ends = np.zeros(n + 1, bool)
    ends[0] = ends[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        first = np.cumsum(size) - size
        rows = np.arange(total) + np.repeat(low - first, size)
        target = to[rows]
        # Rows of one interval that are preceded by one byte go to neighbouring rows.
        mark = np.repeat(np.arange(len(low)), size) * 256 + last[rows]
        if total > len(low):
            order = np.argsort(mark, kind="stable")
            mark, target = mark[order], target[order]
        begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        lows, highs = target[begin], target[np.append(begin[1:], total) - 1] + 1
        new = np.flatnonzero(~ends[highs])
        _, once = np.unique(highs[new], return_index=True)
        new = new[once]
        ends[highs[new]] = True
        low, high = lows[new], highs[new]
    return suffixes, ends[:n]
