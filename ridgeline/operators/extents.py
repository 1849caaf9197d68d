"""Extents against extents: the pairs that touch, by a grid of buckets in levels.

An extent's level is the least at which its sides are no longer than two buckets' (each level
doubles the bucket), so it lies in nine buckets of its level at most; twice as long buckets
leave half as many pairs again to look at. It also stands in the
buckets of every higher level that the other side has extents of. Two extents meet at the
higher of their levels, and are reported by the bucket that holds the lower left corner of
what they share: once, without a distinct. Large extents thus meet small ones in few, large
buckets, and small ones never see each other there: a bucket is apart for the left side's own
extents, with the right's of its level and below, and for the right side's own.

Buckets are counted first. One with many pairs to look at is cut into blocks of rows of one
side by rows of the other, and blocks go to a number of tasks that follows from the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.storage import materialise_with

_BOX = ("xmin", "ymin", "xmax", "ymax")


def _level(prefix: str) -> Column:
    """The least whole power of two that is as long as the longer side; points have the lowest level that is used, -40."""
    side = F.greatest(F.col(prefix + "xmax") - F.col(prefix + "xmin"), F.col(prefix + "ymax") - F.col(prefix + "ymin"))
    return F.greatest(F.lit(-40), F.when(side > 0, F.ceil(F.log2(side))).otherwise(-40)).cast("int")


def _dealt(extents: DataFrame, prefix: str, levels: list[int], left: bool) -> DataFrame:
    """A row for each bucket of an extent's own level and of the other side's levels above it; ``of_left`` tells whose own bucket it is."""
    own = F.col(prefix + "level")
    others = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v > own if left else v >= own)
    at = F.concat(F.array(F.struct(own.alias("level"), F.lit(left).alias("of_left"))), F.transform(others, lambda v: F.struct(v.alias("level"), F.lit(not left).alias("of_left"))))
    size = F.pow(F.lit(2.0), F.col("level") - 1)
    first = {f"{prefix}{to}": F.floor(F.col(f"{prefix}{k}") / size) for k, to in (("xmin", "bx"), ("ymin", "by"))}
    last = lambda k: F.floor(F.col(prefix + k) / size)
    each = extents.select("*", F.inline(at)).withColumns(first)
    each = each.withColumn("bx", F.explode(F.sequence(F.col(f"{prefix}bx"), last("xmax")))).withColumn("by", F.explode(F.sequence(F.col(f"{prefix}by"), last("ymax"))))
    # Whether the extent begins in this column and row of buckets.
    return each.withColumns({k: F.col(k) == F.col(k[-2:]) for k in first}).drop(prefix + "level")


_BUCKET = ["level", "of_left", "bx", "by"]
#: Pairs that a block has at most, pairs for a task, buckets that are cut (a broadcast of their numbers), and tasks.
BLOCK_PAIRS, TASK_PAIRS, CUT, TASKS = 1 << 22, 1 << 25, 10_000, 10_000


def _in_blocks(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them by: the bucket, and where there are many pairs the block within it."""
    spark = first.sparkSession
    # Merged, here and below: Spark takes exploded rows for no more bytes than the extents have, and would broadcast them.
    each = first.groupBy(*_BUCKET).agg(F.count("*").alias("n")).join(second.groupBy(*_BUCKET).agg(F.count("*").alias("m")).hint("merge"), _BUCKET)
    pairs = F.col("n").cast("double") * F.col("m")
    buckets, measures = materialise_with(each, "extent_buckets", pairs=F.sum(pairs))
    total = measures["pairs"] or 0.0
    if total <= BLOCK_PAIRS:
        return first, second, _BUCKET
    most = max(BLOCK_PAIRS, total / CUT)
    side = int(most**0.5)
    cut = F.broadcast(buckets.filter(pairs > most).select(*_BUCKET, F.ceil(F.col("n") / side).alias("of_i"), F.ceil(F.col("m") / side).alias("of_j")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, int(total / TASK_PAIRS) + 1))

    def blocks(rows: DataFrame, own: str, other: str) -> DataFrame:
        hashed = F.xxhash64(*[k for k, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
        n = lambda k: F.coalesce(F.col(f"of_{k}"), F.lit(1).cast("long"))
        at = rows.join(cut, _BUCKET, "left").withColumn(own, F.pmod(hashed, n(own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), n(other) - 1)))
        return at.drop("of_i", "of_j").repartition(tasks, *_BUCKET, "i", "j")

    return blocks(first, "i", "j"), blocks(second, "j", "i"), [*_BUCKET, "i", "j"]


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides whose extents (xmin, ymin, xmax, ymax) touch, once each pair; the right's are named ``right_xmin`` and so on.

    Extents with a null, or turned inside out, touch none. The other columns of both sides
    must have names of their own.
    """
    known = lambda df: df.filter(" AND ".join(f"{k} IS NOT NULL AND NOT isnan({k})" for k in _BOX) + " AND xmin <= xmax AND ymin <= ymax")
    a = known(left).withColumn("_level", _level(""))
    b = known(right).withColumnsRenamed({k: f"right_{k}" for k in _BOX}).withColumn("right_level", _level("right_"))
    # Some tens of levels at most: lengths of doubles.
    of_a, of_b = ([r[0] for r in x.select(c).distinct().collect()] for x, c in ((a, "_level"), (b, "right_level")))
    a = a.withColumnRenamed("_level", "left_level").withColumnsRenamed({k: f"left_{k}" for k in _BOX})
    first, second, by = _in_blocks(_dealt(a, "left_", of_b, True), _dealt(b, "right_", of_a, False))
    touch = (F.col("left_xmin") <= F.col("right_xmax")) & (F.col("right_xmin") <= F.col("left_xmax")) & (F.col("left_ymin") <= F.col("right_ymax")) & (F.col("right_ymin") <= F.col("left_ymax"))
    # What two extents share begins where the later of them begins, and neither begins beyond a bucket it stands in.
    once = (F.col("left_bx") | F.col("right_bx")) & (F.col("left_by") | F.col("right_by"))
    met = first.join(second.hint("merge"), by).filter(touch & once).drop(*by, "left_bx", "left_by", "right_bx", "right_by")
    return met.withColumnsRenamed({f"left_{k}": k for k in _BOX})
