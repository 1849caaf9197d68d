"""Connected components by alternating stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.storage import materialise_with


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and a sum of hashes, which tell whether a round changed any."""
    table, seen = materialise_with(edges, name, n=F.count(F.lit(1)), hashes=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return table, (seen["n"], seen["hashes"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """From edges (a, b): each node that has an edge, as ``id``, and the least node it reaches.

    Alternates large and small stars until each component is one star, which takes a
    number of rounds that is logarithmic in its size. Rounds end in a table, not in a
    growing plan. Loops and repeated edges are allowed; edges with a null are ignored.
    """
    loops = edges.filter("a = b").select("a").distinct()
    edges, before = _written(edges.filter("a <> b").select("a", "b").distinct(), name)
    while before[0]:
        edges, now = _written(_small_star(_large_star(edges)), name)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = leaves.unionByName(roots)
    alone = loops.select(F.col("a").alias("id"), F.col("a").alias("component")).join(found, "id", "left_anti")
    return found.unionByName(alone)
