"""Small native column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a membership filter: it broadcasts at most 2^24 / 8 bytes = 2 MB at any input size.
FILTER_BITS = 24
_PER_BUCKET = 32768


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(1 << FILTER_BITS)) + 1


def member_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of 64-bit hashed keys, as at most 2^24 / 32768 = 512 rows of 4 KB."""
    return keys.select(F.bitmap_bucket_number(_place(F.col(key))).alias("_bucket"), F.bitmap_bit_position(_place(F.col(key))).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def mark_members(df: DataFrame, key: Column, members: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: false only for rows whose key is not in the filter.

    The filter's size has a bound whatever the input, so it is broadcast; where it
    fills up, more rows are flagged than need be, and none too few.
    """
    bit = F.bitmap_bit_position(_place(key))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("_bits").isNotNull() & (F.getbit(octet, (bit % 8).cast("int")) == 1)
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(_place(key))).join(F.broadcast(members), "_bucket", "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")
