"""Files in several coordinate systems on one grid.

Every target cell that a file can cover asks for the cell of the file that its centre is
in: the target's coordinates go through longitude and latitude to the file's system. So
there are no gaps, and files meet in one join on the cells they ask for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.operators.rasters import mosaic, reprojected

_FIELDS = ("rows", "cols", "cell", "epsg", "x0", "y0", "px", "py")
#: Points along each side of a file that bound it in the target's system, and target cells that the bound is widened by.
SIDE, SLACK = 64, 2
#: Cells along a block's side, and target cells that one task works out.
BLOCK, TASK_CELLS = 256, 1_000_000


def catalogue_of(spark: SparkSession, files: dict[str, GridMeta]) -> DataFrame:
    """A catalogue as ``raster_catalog`` gives it, for grids at hand."""
    rows = [(name, m.rows, m.cols, float(m.cell), m.epsg, float(m.x0), float(m.y0), float(m.px), float(m.py)) for name, m in files.items()]
    return spark.createDataFrame(rows, "path string, rows int, cols int, cell double, epsg int, x0 double, y0 double, px double, py double")


def _systems(catalogue: DataFrame) -> list[int]:
    """The files' systems, which are few."""
    return sorted(r.epsg for r in catalogue.select("epsg").distinct().collect())


def _between(df: DataFrame, x: Column, y: Column, systems: list[int], target: int, back: bool = False) -> DataFrame:
    """Adds tx and ty: x and y from the row's own system (``epsg``) in the target's, or the other way back.

    Each system has a branch of its own, as parts of a formula that come again are worked out
    once only outside conditions. Longitude and latitude are columns on the way, as formulas
    of formulas grow too long.
    """

    def of(e: int) -> DataFrame:
        a, b = (target, e) if back else (e, target)
        lon, lat = reprojected(x, y, a, 4326)
        tx, ty = reprojected(F.col("lon"), F.col("lat"), 4326, b)
        return df.filter(F.col("epsg") == e).withColumns({"lon": lon, "lat": lat}).withColumns({"tx": tx, "ty": ty}).drop("lon", "lat")

    if not systems:
        return df.withColumns({k: F.lit(None).cast("double") for k in ("tx", "ty")})
    return reduce(DataFrame.unionByName, map(of, systems))


def footprints(catalogue: DataFrame, epsg: int) -> DataFrame:
    """The catalogue with each file's bounds in a system: xmin, ymin, xmax, ymax, from points along its border."""
    files = catalogue.select("path", *_FIELDS)
    return files.join(_bounds(files, ["path"], _systems(catalogue), epsg), "path")


def _bounds(files: DataFrame, keys: list[str], systems: list[int], epsg: int) -> DataFrame:
    t = F.col("id") % (SIDE + 1) / F.lit(float(SIDE))
    side = F.floor(F.col("id") / (SIDE + 1))
    u, v = F.when(side < 2, t).otherwise(side - 2), F.when(side < 2, side).otherwise(t)
    border = files.select("*", F.explode(F.sequence(F.lit(0), F.lit(4 * SIDE + 3))).alias("id")).withColumns({"x": F.col("x0") + u * F.col("cols") * F.col("px"), "y": F.col("y0") + v * F.col("rows") * F.col("py")})
    placed = _between(border, F.col("x"), F.col("y"), systems, epsg)
    return placed.groupBy(*keys).agg(F.min("tx").alias("xmin"), F.min("ty").alias("ymin"), F.max("tx").alias("xmax"), F.max("ty").alias("ymax"))


def _blocks(catalogue: DataFrame) -> DataFrame:
    """The catalogue's files in blocks of ``BLOCK`` cells a side: each as a file, with its first cell in the whole one as r0 and c0, and the whole one's corner as left and top."""
    first = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(BLOCK)))
    at = catalogue.select("path", *_FIELDS).filter("rows > 0 AND cols > 0").withColumn("r0", first("rows")).withColumn("c0", first("cols"))
    return at.withColumns({"left": F.col("x0"), "top": F.col("y0"), "x0": F.col("x0") + F.col("c0") * F.col("px"), "y0": F.col("y0") + F.col("r0") * F.col("py"), "rows": F.least(F.lit(BLOCK), F.col("rows") - F.col("r0")), "cols": F.least(F.lit(BLOCK), F.col("cols") - F.col("c0"))})


def mixed_meta(catalogue: DataFrame, epsg: int, cell: float) -> GridMeta:
    """The grid, on multiples of its cell, over all files."""
    b = footprints(catalogue, epsg).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if b[0] is None:
        raise ValueError("no file with a georeference")
    x0, y0 = math.floor(b[0] / cell) * cell, math.ceil(b[3] / cell) * cell
    return GridMeta(math.ceil((y0 - b[1]) / cell), math.ceil((b[2] - x0) / cell), cell, x0, y0, cell, -cell, epsg)


def warped(cells: DataFrame, catalogue: DataFrame, target: GridMeta) -> DataFrame:
    """Cells (path, r, c, z) of files in their own systems, on the target's grid: (path, r, c, z), nearest cells.

    Target cells are asked for by the bounds of blocks of a file, not of the whole, which a
    long file that lies aslant leaves all but empty; a cell is the block's that its centre is in.
    """
    # A centre may lie a little beyond the bound of a curved border.
    ends = lambda a, b, n: (F.greatest(F.lit(0), F.floor(F.least(a, b)).cast("int") - SLACK), F.least(F.lit(n - 1), F.floor(F.greatest(a, b)).cast("int") + SLACK))
    row = lambda y: (F.col(y) - target.y0) / target.py
    col = lambda x: (F.col(x) - target.x0) / target.px
    inside = (F.greatest(row("ymin"), row("ymax")) + SLACK >= 0) & (F.least(row("ymin"), row("ymax")) - SLACK < target.rows) & (F.greatest(col("xmin"), col("xmax")) + SLACK >= 0) & (F.least(col("xmin"), col("xmax")) - SLACK < target.cols)
    blocks, systems, block = _blocks(catalogue), _systems(catalogue), ["path", "r0", "c0"]
    met = blocks.join(_bounds(blocks, block, systems, target.epsg).filter(inside), block)
    rows, cols = ends(row("ymin"), row("ymax"), target.rows), ends(col("xmin"), col("xmax"), target.cols)
    wide = lambda e: F.greatest(F.lit(0), e[1] - e[0] + 1).cast("long")
    asked = met.agg(F.sum(wide(rows) * wide(cols))).first()[0] or 0
    # A block's rows are dealt out before they become cells: to a number of tasks, as few bytes of rows become many cells.
    spark = cells.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked // TASK_CELLS + 1)
    by_row = met.withColumn("r", F.explode(F.sequence(*rows))).repartition(tasks, *block, "r")
    placed = _between(by_row.withColumn("c", F.explode(F.sequence(*cols))), target.x(), target.y(), systems, target.epsg, back=True)
    # Inlined, as filters would else work the formulas out once more below.
    at = F.struct(F.floor((F.col("ty") - F.col("top")) / F.col("py")).alias("sr"), F.floor((F.col("tx") - F.col("left")) / F.col("px")).alias("sc"))
    held = placed.select("*", F.inline(F.array(at))).filter("sr >= r0 AND sr < r0 + rows AND sc >= c0 AND sc < c0 + cols")
    found = held.select("path", "r", "c", F.col("sr").cast("int").alias("sr"), F.col("sc").cast("int").alias("sc"))
    # Merged: Spark takes exploded rows for no more bytes than the blocks' rows have, and would broadcast them.
    return found.join(cells.select("path", F.col("r").alias("sr"), F.col("c").alias("sc"), "z").hint("merge"), ["path", "sr", "sc"]).select("path", "r", "c", "z")


def merge_mixed(cells: DataFrame, catalogue: DataFrame, epsg: int, cell: float) -> tuple[DataFrame, GridMeta]:
    """Files in any known systems as one grid; where they overlap the last path with data wins."""
    target = mixed_meta(catalogue, epsg, cell)
    return mosaic(warped(cells, catalogue, target), order="path"), target
