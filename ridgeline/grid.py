"""Elevation grids as tables of cells: (r INT, c INT, value columns), null for nodata.

A grid is dense: it has a row for every cell. Sizes and the georeference are plain
values beside it, in ``GridMeta``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What is said of a grid: columns, rows, cell and CRS.
INFO = "%d x %d px | %.2f m/px | EPSG:%d"


def info_text(cols: Column, rows: Column, cell: Column, epsg: Column) -> Column:
    """``GridMeta.info`` for the rows of a catalogue."""
    return F.format_string(INFO, cols, rows, cell, epsg)


@dataclass(frozen=True)
class GridMeta:
    rows: int
    cols: int
    cell: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    px: float = 1.0
    py: float = -1.0
    epsg: int = 0

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax."""
        xs, ys = (self.x0, self.x0 + self.cols * self.px), (self.y0, self.y0 + self.rows * self.py)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def info(self) -> str:
        return INFO % (self.cols, self.rows, self.cell, self.epsg)

    def x(self) -> Column:
        return F.lit(self.x0) + (F.col("c") + 0.5) * self.px

    def y(self) -> Column:
        return F.lit(self.y0) + (F.col("r") + 0.5) * self.py

    def id(self, r: Column | str = "r", c: Column | str = "c") -> Column:
        r, c = (F.col(v) if isinstance(v, str) else v for v in (r, c))
        return r.cast("long") * self.cols + c

    def stamped(self, epsg: int) -> GridMeta:
        """With a CRS, if it has none."""
        return self if self.epsg else replace(self, epsg=epsg)

    def with_cell(self, cell: float) -> GridMeta:
        return replace(self, cell=cell)


def cell_metres(px: float, geographic: bool = False, mercator: bool = False, latitude: float = 0.0) -> float:
    """Cell size in metres from the pixel's width; Web Mercator is corrected only on request."""
    if geographic:
        return abs(px) * 111320 * math.cos(math.radians(abs(latitude)))
    return abs(px) * (math.cos(math.radians(latitude)) if mercator else 1.0)


def densify(spark: SparkSession, sparse: DataFrame, meta: GridMeta) -> DataFrame:
    """A row for every cell; absent cells are null."""
    n = meta.rows * meta.cols
    frame = spark.range(n).select((F.col("id") / meta.cols).cast("int").alias("r"), (F.col("id") % meta.cols).cast("int").alias("c"))
    return frame.join(sparse, ["r", "c"], "left")


def from_keys(df: DataFrame, key: str, cols: int, value: Column) -> DataFrame:
    """A grid from a table whose dense key numbers cells row by row."""
    k = F.col(key)
    return df.select(F.floor(k / cols).cast("int").alias("r"), (k % cols).cast("int").alias("c"), value.alias("z"))
