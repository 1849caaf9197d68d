"""Minimal perfect hash of 128-bit keys, in arrays: bit levels with a rank directory.

Each level deals the keys that are left to ``SPREAD`` places a key; a key alone at its
place gets the place's bit, the others go on to the next level. A key's slot is the
number of bits before its own, so n keys have the slots 0 to n - 1, at about 4 bits a
key. A key that wasn't built in gets a slot or -1, so slots need a fingerprint beside.
"""

from __future__ import annotations

import numpy as np

SPREAD = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Both halves of a key decide, so keys that differ in one part at some level."""
    return (_mix(_mix(a + np.uint64(level)) ^ b) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, and their words, for distinct keys (a, b) of two uint64."""
    sizes, words = [], []
    while len(a):
        size = (int(len(a) * SPREAD) // 64 + 1) * 64
        place = _places(a, b, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = ~alone[place]
        a, b = a[left], b[left]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


class Slots:
    """Looks slots up in levels that ``build`` made."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = start + _places(a[left], b[left], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) == 1
            rank = self.before[place >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = rank[hit]
            left, start = left[~hit], start + size
            if not len(left):
                break
        return slot
