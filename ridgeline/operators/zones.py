"""Zones: 4-connected regions of a mask, and their statistics; ``outlines`` has their borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.operators.graph import connected_components


def label_zones(mask: DataFrame, meta: GridMeta) -> DataFrame:
    """Rows (r, c) of cells in the mask to (r, c, zone): the least cell number of the region."""
    cells = mask.select("r", "c", meta.id().alias("id"))
    # Neighbours meet by their number: two equi-joins, no window over the sparse mask.
    right = cells.filter(F.col("c") < meta.cols - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    below = cells.select(F.col("id").alias("a"), (F.col("id") + meta.cols).alias("b"))
    there = cells.select(F.col("id").alias("b"))
    edges = right.unionByName(below).join(there, "b", "left_semi").select("a", "b")
    labels = connected_components(edges, "zones")
    return cells.join(labels, "id", "left").select("r", "c", F.coalesce("component", "id").alias("zone"))


def zone_statistics(zones: DataFrame, meta: GridMeta) -> DataFrame:
    """One row per zone: zone, value 1, n_cells, area, bounding box and centroid."""
    half_x, half_y = abs(meta.px) / 2, abs(meta.py) / 2
    at = zones.select("zone", meta.x().alias("x"), meta.y().alias("y"))
    return at.groupBy("zone").agg(
        F.lit(1).alias("value"),
        F.count("*").alias("n_cells"),
        (F.count("*") * (meta.cell * meta.cell)).alias("area"),
        (F.min("x") - half_x).alias("xmin"),
        (F.min("y") - half_y).alias("ymin"),
        (F.max("x") + half_x).alias("xmax"),
        (F.max("y") + half_y).alias("ymax"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
    )
