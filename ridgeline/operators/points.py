"""Point clouds and XYZ texts to grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta


#: The CRS of survey texts and of survey files that name none.
SURVEY_EPSG = 6676


def surface_meta(points: DataFrame, cell: float = 0.5) -> GridMeta:
    """The grid of a point cloud: one cell more than its extent needs."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.ceil((F.max("x") - F.min("x")) / cell), F.ceil((F.max("y") - F.min("y")) / cell)).first()
    return GridMeta(int(b[5]) + 1, int(b[4]) + 1, cell, b[0], b[3], cell, -cell)


def highest(points: DataFrame, meta: GridMeta, ymin: float) -> DataFrame:
    """Points (x, y, z) to (r, c, z): the highest of each cell. Cells without a point have no row."""
    c = F.floor((F.col("x") - meta.x0) / meta.cell).cast("int")
    r = meta.rows - 1 - F.floor((F.col("y") - ymin) / meta.cell).cast("int")
    return points.groupBy(r.alias("r"), c.alias("c")).agg(F.max("z").alias("z"))


def parse_xyz(lines: DataFrame) -> DataFrame:
    """Rows (file, line_no, line) to (file, line_no, x, y, z).

    The first line of a file that isn't blank tells its layout: with a comma ``id,x,y,z``
    and more, else three numbers and white space. Lines that don't fit are left out.
    """
    text = F.trim("line")
    filled = lines.filter(F.length(text) > 0)
    layout = filled.groupBy("file").agg(F.min_by(F.contains(text, F.lit(",")), "line_no").alias("commas"))
    at = filled.join(layout, "file").withColumn("f", F.when(F.col("commas"), F.split(text, ",")).otherwise(F.split(text, r"\s+")))
    fits = F.when(F.col("commas"), F.size("f") >= 4).otherwise(F.size("f") == 3)
    shift = F.when(F.col("commas"), 1).otherwise(0)
    number = lambda k: F.expr(f"try_cast(trim(get(f, {k} + _s)) AS DOUBLE)")
    parsed = at.filter(fits).withColumn("_s", shift).select("file", "line_no", number(0).alias("x"), number(1).alias("y"), number(2).alias("z"))
    return parsed.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def xyz_meta(points: DataFrame, cell: float = 0.5) -> GridMeta:
    """The grid whose cell centres the points are; sizes are rounded half to even."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    half = cell / 2
    return GridMeta(round((b[3] - b[2] + cell) / cell), round((b[1] - b[0] + cell) / cell), cell, b[0] - half, b[3] + half, cell, -cell, SURVEY_EPSG)


def latest(points: DataFrame, meta: GridMeta, order: str = "line_no") -> DataFrame:
    """Points (x, y, z) to (r, c, z FLOAT): the last of each cell in the order given."""
    c = F.rint((F.col("x") - meta.x0 - meta.cell / 2) / meta.cell).cast("int")
    ymin = meta.y0 - meta.rows * meta.cell
    r = meta.rows - 1 - F.rint((F.col("y") - ymin - meta.cell / 2) / meta.cell).cast("int")
    inside = points.withColumns({"r": r, "c": c}).filter(F.col("r").between(0, meta.rows - 1) & F.col("c").between(0, meta.cols - 1))
    return inside.groupBy("r", "c").agg(F.max_by("z", order).cast("float").alias("z"))


def xyz_catalog(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """``xyz_meta`` for each file of points (file, x, y), a row each, as raster catalogues have them."""
    b = points.groupBy("file").agg(F.min("x").alias("_x"), F.max("x").alias("_xx"), F.min("y").alias("_y"), F.max("y").alias("_yy"))
    size = lambda low, high: F.rint((F.col(high) - F.col(low) + cell) / cell).cast("int")
    half = cell / 2
    out = b.select("file", size("_y", "_yy").alias("rows"), size("_x", "_xx").alias("cols"), F.lit(cell).alias("cell"), F.lit(SURVEY_EPSG).alias("epsg"), (F.col("_x") - half).alias("x0"), (F.col("_yy") + half).alias("y0"), F.lit(cell).alias("px"), F.lit(-cell).alias("py"))
    return out.withColumns({"xmin": F.col("x0"), "ymin": F.col("y0") - F.col("rows") * cell, "xmax": F.col("x0") + F.col("cols") * cell, "ymax": F.col("y0")})


def latest_of_files(points: DataFrame, cell: float = 0.5, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """``latest`` for each file on a grid of its own: cells (file, r, c, z FLOAT), and the files' catalogue."""
    catalogue = xyz_catalog(points, cell)
    at = points.join(catalogue.select("file", "rows", "cols", "x0", "ymin"), "file")
    c = F.rint((F.col("x") - F.col("x0") - cell / 2) / cell).cast("int")
    r = F.col("rows") - 1 - F.rint((F.col("y") - F.col("ymin") - cell / 2) / cell).cast("int")
    inside = at.withColumns({"r": r, "c": c}).filter((F.col("r") >= 0) & (F.col("r") < F.col("rows")) & (F.col("c") >= 0) & (F.col("c") < F.col("cols")))
    return inside.groupBy("file", "r", "c").agg(F.max_by("z", order).cast("float").alias("z")), catalogue
