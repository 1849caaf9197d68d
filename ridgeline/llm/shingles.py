"""Word shingles of whole texts as sorted 63-bit hashes, computed over arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        for i, base in enumerate((_P, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a quarter of a megabyte, for which a worker needs some 20 MB; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the word number at which each text begins."""
    buffer = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    word = ~_SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = power_tables(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[buffer] * up[: len(buffer)], dtype=np.uint64)])
    hashes = mix64((sums[last] - sums[first]) * down[first])
    return hashes, np.searchsorted(first, begins)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words, the one of all of them."""
    words, at = word_hashes(texts)
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        rolled = rolled * _M + words[j : j + n]
    rolled = mix64(rolled) >> np.uint64(1)
    out = []
    for start, stop in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if stop - start >= size:
            out.append(np.unique(rolled[start : stop - size + 1]))
        elif stop > start:
            value = np.uint64(stop - start)
            with np.errstate(over="ignore"):
                for w in words[start:stop]:
                    value = value * _M + w
                out.append(mix64(np.array([value])) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
