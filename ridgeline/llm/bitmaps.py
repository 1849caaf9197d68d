"""Bitmaps of hashed keys for tasks that work on arrays: of fixed size, whatever the input.

A key that was put in is always found; where a bitmap fills up, more of the others are
found too, so it may only be used to leave out what is surely not wanted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^27 bits are 16 MB, on the driver and in each worker.
BITS = 27


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The bits of a column of 64-bit keys; the driver gets 4 KB pieces of them."""
    place = F.pmod(F.col(column), F.lit(1 << BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may have been put in."""
    place = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
