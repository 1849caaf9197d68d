"""Stored cells in tiles: a folder a tile, cells in order of row and column within it.

A window or some points read the folders of their tiles alone, and of those the row groups
whose rows fit. Tiles are sized so that a folder holds some hundred megabytes of layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.operators.rasters import FEW, cell_of, clip_window

#: Cells along a tile's edge.
TILE = 2048
#: Bytes of a row group, so that a folder has several.
ROW_GROUP = 16 << 20


def _across(meta: GridMeta, tile: int) -> int:
    return -(-meta.cols // tile)


def _tile(meta: GridMeta, tile: int) -> Column:
    return (F.floor(F.col("r") / tile) * _across(meta, tile) + F.floor(F.col("c") / tile)).cast("int")


def write_cells(cells: DataFrame, meta: GridMeta, path: str, tile: int = TILE) -> None:
    """Cells (r, c and layers) to a new folder; a tile is written by one task."""
    placed = cells.withColumn("tile", _tile(meta, tile))
    placed.repartition("tile").sortWithinPartitions("tile", "r", "c").write.option("parquet.block.size", ROW_GROUP).partitionBy("tile").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells, without the tiles' numbers."""
    return spark.read.parquet(path).drop("tile")


def read_window(spark: SparkSession, path: str, meta: GridMeta, xmin: float, ymin: float, xmax: float, ymax: float, tile: int = TILE) -> tuple[DataFrame, GridMeta]:
    """The cells of an extent, numbered anew, from the folders that it touches."""
    r0, c0, r1, c1 = clip_window(meta, xmin, ymin, xmax, ymax)
    n = _across(meta, tile)
    near = F.floor(F.col("tile") / n).between(r0 // tile, (r1 - 1) // tile) & (F.col("tile") % n).between(c0 // tile, (c1 - 1) // tile)
    inside = F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)
    cut = spark.read.parquet(path).filter(near & inside).drop("tile").withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
    return cut, GridMeta(r1 - r0, c1 - c0, meta.cell, meta.x0 + c0 * meta.px, meta.y0 + r0 * meta.py, meta.px, meta.py, meta.epsg)


def sample_stored(points: DataFrame, path: str, meta: GridMeta, value: str = "z", epsg: int | None = None, tile: int = TILE) -> DataFrame:
    """``rasters.sample_points`` on stored cells: the folders of the points' tiles are read, and few points are sent to them.

    Up to ``FEW`` points are few; the driver gets the numbers of their tiles. Of more points,
    points and cells are dealt out by cell.
    """
    r, c = cell_of(meta, epsg)
    at = points.withColumns({"r": r, "c": c})
    stored = points.sparkSession.read.parquet(path)
    known = at.filter(F.col("r").between(0, meta.rows - 1) & F.col("c").between(0, meta.cols - 1)).select("r", "c")
    if points.limit(FEW + 1).count() > FEW:
        return at.join(stored.select("r", "c", value), ["r", "c"], "left").drop("r", "c")
    cells = known.distinct()
    tiles = [x.tile for x in cells.select(_tile(meta, tile).alias("tile")).distinct().collect()]
    hits = stored.filter(F.col("tile").isin(tiles)).select("r", "c", value).join(F.broadcast(cells), ["r", "c"], "left_semi")
    return at.join(F.broadcast(hits), ["r", "c"], "left").drop("r", "c")  # a row for each cell of few points, at most
