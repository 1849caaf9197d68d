"""Focal operators: 3x3 and 5x5 neighbourhoods by two window passes over rows and columns.

Grid edge and nodata differ: beyond the edge the nearest cell repeats (slope, curvature,
complexity, blur mirrors it) or nothing is there (drainage); a nodata neighbour makes
slope and curvature null, and is passed over by complexity and drainage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta



#: Drainage codes in order of preference: code, row step, column step, distance in cells (fixed values).
D8 = ((32, -1, -1, 1.4142), (64, -1, 0, 1.0), (128, -1, 1, 1.4142), (16, 0, -1, 1.0), (1, 0, 1, 1.0), (8, 1, -1, 1.4142), (4, 1, 0, 1.0), (2, 1, 1, 1.4142))
DIAGONAL = (2, 8, 32, 128)


def _row():
    return Window.partitionBy("r").orderBy("c")


def _col():
    return Window.partitionBy("c").orderBy("r")


def neighbours(grid: DataFrame, value: str = "z") -> DataFrame:
    """Adds _nw _n _ne _w _e _sw _s _se; null where there is no cell or no data."""
    across = grid.withColumn("_w", F.lag(value).over(_row())).withColumn("_e", F.lead(value).over(_row()))
    line = F.struct(F.col("_w").alias("w"), F.col(value).alias("m"), F.col("_e").alias("e"))
    both = across.withColumn("_line", line).withColumn("_up", F.lag("_line").over(_col())).withColumn("_down", F.lead("_line").over(_col()))
    names = {"_nw": "_up.w", "_n": "_up.m", "_ne": "_up.e", "_sw": "_down.w", "_s": "_down.m", "_se": "_down.e"}
    return both.withColumns({k: F.col(v) for k, v in names.items()}).drop("_line", "_up", "_down")


def _repeated(meta: GridMeta, value: str) -> tuple[Column, Column, Column, Column]:
    """West, east, north and south with the edge repeated."""
    v = F.col(value)
    at = ((F.col("c") == 0, "_w"), (F.col("c") == meta.cols - 1, "_e"), (F.col("r") == 0, "_n"), (F.col("r") == meta.rows - 1, "_s"))
    return tuple(F.when(edge, v).otherwise(F.col(k)) for edge, k in at)


def gradients(grid: DataFrame, meta: GridMeta, value: str = "z") -> DataFrame:
    """Adds dzdx and dzdy by central differences, and the neighbours."""
    w, e, n, s = _repeated(meta, value)
    known = F.col(value).isNotNull()
    out = neighbours(grid, value)
    return out.withColumns({"dzdx": F.when(known, (e - w) / (2.0 * meta.cell)), "dzdy": F.when(known, (s - n) / (2.0 * meta.cell))})


def slope_of(dzdx: Column, dzdy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy)))


def slope(grid: DataFrame, meta: GridMeta, value: str = "z") -> DataFrame:
    """Adds slope in degrees."""
    return gradients(grid, meta, value).withColumn("slope", slope_of(F.col("dzdx"), F.col("dzdy"))).select(*grid.columns, "slope")


def curvature_of(meta: GridMeta, value: str = "z") -> Column:
    w, e, n, s = _repeated(meta, value)
    v, square = F.col(value), meta.cell * meta.cell
    return -((e - 2 * v + w) / square + (s - 2 * v + n) / square)


def curvature(grid: DataFrame, meta: GridMeta, value: str = "z") -> DataFrame:
    """Adds curvature: positive on ridges, negative in valleys."""
    return neighbours(grid, value).withColumn("curvature", curvature_of(meta, value)).select(*grid.columns, "curvature")


def _clamped(column: str, window, index: str, n: int) -> list[Column]:
    """The values two before to two after along a line, with its ends repeated."""
    v, i = F.col(column), F.col(index)
    lag = [v, F.lag(column, 1).over(window), F.lag(column, 2).over(window)]
    lead = [v, F.lead(column, 1).over(window), F.lead(column, 2).over(window)]
    before = [F.when(i >= 1, lag[1]).otherwise(v), F.when(i >= 2, lag[2]).when(i == 1, lag[1]).otherwise(v)]
    last = n - 1
    after = [F.when(i <= last - 1, lead[1]).otherwise(v), F.when(i <= last - 2, lead[2]).when(i == last - 1, lead[1]).otherwise(v)]
    return [*before, v, *after]


def _plus(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def surface_complexity(grid: DataFrame, meta: GridMeta, value: str = "z") -> DataFrame:
    """Adds shc: the population deviation of curvature in 5x5 cells, as a float.

    The edge repeats, so border cells count more than once; cells without a curvature
    are passed over, and with one value or none the result is 0. Null where z is.
    """
    bent = curvature(grid, meta, value)
    known = F.struct(F.when(F.col("curvature").isNull(), 0).otherwise(1).alias("k"), F.coalesce("curvature", F.lit(0.0)).alias("v"), F.coalesce(F.col("curvature") * F.col("curvature"), F.lit(0.0)).alias("q"))
    row = _clamped("_one", _row(), "c", meta.cols)
    summed = F.struct(*[_plus([p[f] for p in row]).alias(f) for f in ("k", "v", "q")])
    lines = bent.withColumn("_one", known).withColumn("_line", summed)
    column = _clamped("_line", _col(), "r", meta.rows)
    total = lines.withColumn("_all", F.struct(*[_plus([p[f] for p in column]).alias(f) for f in ("k", "v", "q")]))
    k, v, q = (F.col(f"_all.{f}") for f in ("k", "v", "q"))
    deviation = F.when(k <= 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), q / k - (v / k) * (v / k))))
    return total.withColumn("shc", F.when(F.col(value).isNotNull(), deviation).cast("float")).select(*grid.columns, "shc")


def direction_of(value: str = "z") -> Column:
    """The code of the steepest way down; of equals the first in ``D8``; 0 for pits, flats and nodata."""
    names = {(-1, -1): "_nw", (-1, 0): "_n", (-1, 1): "_ne", (0, -1): "_w", (0, 1): "_e", (1, -1): "_sw", (1, 0): "_s", (1, 1): "_se"}
    drops = [((F.col(value) - F.col(names[dr, dc])) / d, code) for code, dr, dc, d in D8]
    most = F.greatest(*[d for d, _ in drops])
    pick = F.when(most.isNull() | (most <= 0), 0)
    for drop, code in drops:
        pick = pick.when(drop == most, code)
    return F.coalesce(pick, F.lit(0)).cast("short")


def flow_direction(grid: DataFrame, value: str = "z") -> DataFrame:
    """Adds fdir."""
    return neighbours(grid, value).withColumn("fdir", direction_of(value)).select(*grid.columns, "fdir")


def gaussian_blur(grid: DataFrame, meta: GridMeta, value: str, sigma: float = 2.0) -> DataFrame:
    """Adds blurred: nodata counts as 0 and stays nodata; the edge mirrors; the kernel ends at 4 sigma."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = [x / sum(raw) for x in raw]

    def weight(k: int) -> float:
        return kernel[k + radius] if abs(k) <= radius else 0.0

    def line(column: str, window, index: str, n: int) -> Column:
        i, turns = F.col(index), range(-(radius // n) - 2, radius // n + 3)
        back = [t for t in turns if 2 * n * t - 1 >= -radius and 2 * n * (t - 1) + 1 <= radius]
        table = F.array(*[F.lit(x) for x in kernel])
        edge = (i < radius) | (i >= n - radius)
        total = F.lit(0.0)
        for d in range(-min(radius, n - 1), min(radius, n - 1) + 1):
            near = F.col(column) if d == 0 else (F.lead if d > 0 else F.lag)(column, abs(d)).over(window)
            # What stands d cells on is met there, and where the line is mirrored at its ends.
            own = sum(weight(d + 2 * n * t) for t in turns)
            mirrored = sum((F.coalesce(F.get(table, 2 * n * t - 1 - d - 2 * i + radius), F.lit(0.0)) for t in back), F.lit(0.0))
            total = total + F.coalesce(near * (own + F.when(edge, mirrored).otherwise(0.0)), F.lit(0.0))
        return total

    filled = grid.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    across = filled.withColumn("_h", line("_v", _row(), "c", meta.cols))
    both = across.withColumn("_b", line("_h", _col(), "r", meta.rows))
    return both.withColumn("blurred", F.when(F.col(value).isNotNull(), F.col("_b"))).select(*grid.columns, "blurred")
