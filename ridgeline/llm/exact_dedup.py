"""Exact dedup by progressive refinement, in DataFrame operations alone.

Round 1 counts texts by length; round 2 hashes a short prefix of the texts whose
length another text shares; round 3 hashes the full text of those whose length and
prefix another text shares, and groups by that hash. Between rounds a bitmap of
hashed keys with a fixed size says which rows go on, so no text is ever shuffled. A
bit that two keys share only sends a row on that round 3 then finds to be alone.

Texts are equal when identical after lower-casing A-Z only (which keeps lengths).
Null texts count as empty. The row with the largest id stays; null ids are smaller
than all others. Rows that repeat both id and text are alike in every column, and
all of them have the same flag. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.native import ascii_lower, mark_members, member_filter
from ridgeline.storage import materialise

PREFIX_CHARS = 64


def _prefix_hash(text: Column) -> Column:
    return F.xxhash64(F.octet_length(text), ascii_lower(F.substring(text, 1, PREFIX_CHARS)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, content_hash.

    ``content_hash`` is the SHA-256 of the lower-cased text; with ``hash_all`` false
    it is null for rows that no other row could equal, whose full text isn't hashed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, size = F.col("text"), F.octet_length("text")
    lengths = rows.select(size.alias("size")).groupBy("size").count().filter("count > 1").select(F.xxhash64("size").alias("key"))
    by_length = mark_members(rows.select(size.alias("size"), _prefix_hash(text).alias("prefix")), F.xxhash64("size"), member_filter(lengths, "key"), "shared")
    prefixes = by_length.filter("shared").groupBy("prefix").count().filter("count > 1").select(F.col("prefix").alias("key"))
    survivors = mark_members(rows.withColumn("prefix", _prefix_hash(text)), F.col("prefix"), member_filter(prefixes, "key"), "shared")
    full = F.sha2(ascii_lower(text).cast("binary"), 256)
    light = materialise(survivors.select("id", size.alias("size"), "shared", (full if hash_all else F.when(F.col("shared"), full)).alias("content_hash")), "dedup-light")
    groups = light.filter("shared").groupBy("size", "content_hash").agg(F.max("id").alias("best"), F.count("*").alias("n")).filter("n > 1")
    # Rows that are alone for sure get a key each, so that they spread.
    key = F.when(F.col("shared"), F.col("content_hash")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    joined = light.withColumn("key", key).join(groups.select(F.col("content_hash").alias("key"), "best", "n"), "key", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "content_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""
