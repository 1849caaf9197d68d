"""Tile candidates of an extent, their newest survey year, and tile mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.tiles import MAX_PIXELS, REGISTRY, TILE_HEIGHT, TILE_WIDTH, tile_of


def tiles_for_extents(extents: DataFrame) -> DataFrame:
    """Rows (ext_id, xmin, ymin, xmax, ymax) to (ext_id, code): tiles that overlap the extent, touching alone not counting.

    Folders, blocks and tiles are found by number, each within the last. Codes of the quarter
    scheme are held to the extents of the row-and-column scheme like all others, so those that
    hold are among its codes already, and nothing needs to be made distinct but the extents.
    """

    def numbers(low: Column, high: Column, least: int, most: int) -> Column:
        a, b = F.greatest(F.lit(least), low.cast("int")), F.least(F.lit(most), high.cast("int"))
        return F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))

    xmin, ymin, xmax, ymax = (F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    # The folders whose area the extent meets: columns B to F are -3 to 1, rows L to P are 1 to 5.
    at = extents.select("ext_id", "xmin", "ymin", "xmax", "ymax").distinct()
    at = at.withColumn("fc", numbers(F.ceil(xmin / 40000 - 1), F.floor(xmax / 40000), -3, 1)).withColumn("fr", numbers(F.ceil(-ymax / 30000 - 1), F.floor(-ymin / 30000), 1, 5))
    x0, y0 = F.col("fc") * 40000, F.col("fr") * -30000
    at = at.withColumn("xc", numbers((xmin - x0) / 4000, (xmax - x0) / 4000, 0, 9)).withColumn("yr", numbers((y0 - ymax) / 3000, (y0 - ymin) / 3000, 0, 9))
    at = at.withColumns({"bx": x0 + F.col("xc") * 4000, "by": y0 - F.col("yr") * 3000})
    bx, by, gc, gr = (F.col(k) for k in ("bx", "by", "gc", "gr"))
    at = at.withColumn("gc", numbers((xmin - bx) / TILE_WIDTH, (xmax - bx) / TILE_WIDTH, 0, 9)).withColumn("gr", numbers((by - ymax) / TILE_HEIGHT, (by - ymin) / TILE_HEIGHT, 0, 9))
    x, y = bx + gc * TILE_WIDTH, by - gr * TILE_HEIGHT
    held = at.filter((x + TILE_WIDTH > xmin) & (x < xmax) & (y > ymin) & (y - TILE_HEIGHT < ymax))
    letter = lambda names, k: F.substring(F.lit(names), k, F.lit(1))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    code = F.concat(F.lit("08"), letter("LMNOP", F.col("fr")), letter("BCDEF", F.col("fc") + 4), two(F.col("yr") * 10 + F.col("xc")), two(gr * 10 + gc))
    return held.select("ext_id", code.alias("code"))


def resolve_years(codes: DataFrame, catalog: DataFrame, lp_type: str = "Grid") -> DataFrame:
    """Rows (code) to (code, year): the newest year of the catalogue (year, lp_type, code)."""
    found = catalog.filter(F.col("lp_type") == lp_type).groupBy("code").agg(F.max("year").alias("year"))
    return codes.select("code").distinct().join(found, "code")


def original_else_ground(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (code) to (code, year, lp_type): the newest Original, else the newest Ground."""
    original = resolve_years(codes, catalog, "Original")
    rest = codes.select("code").distinct().join(original, "code", "left_anti")
    ground = resolve_years(rest, catalog, "Ground")
    return original.withColumn("lp_type", F.lit("Original")).unionByName(ground.withColumn("lp_type", F.lit("Ground")))


def unreferenced(files: DataFrame, runs: DataFrame, current: str | None = None) -> DataFrame:
    """Cached files (path) that no run's dem_path, nor the current one, refers to."""
    kept = files.join(runs.select(F.col("dem_path").alias("path")), "path", "left_anti")
    return kept.filter(F.col("path") != current) if current else kept


def tile_pixels(pixels: DataFrame, x0: int, y0: int, nx: int, ny: int) -> DataFrame:
    """Decoded tile pixels (tx, ty, px, py, z) to cells of their mosaic; too large a mosaic raises."""
    if nx * ny * 256 * 256 > MAX_PIXELS:
        raise MemoryError(f"{nx} x {ny} tiles are more than {MAX_PIXELS:,} pixels")
    inside = pixels.filter(F.col("tx").between(x0, x0 + nx - 1) & F.col("ty").between(y0, y0 + ny - 1))
    return inside.select(((F.col("ty") - y0) * 256 + F.col("py")).cast("int").alias("r"), ((F.col("tx") - x0) * 256 + F.col("px")).cast("int").alias("c"), "z")


def tile_range(xmin: Column, ymin: Column, xmax: Column, ymax: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """First and last tile of a longitude and latitude extent, clamped to the world."""
    last = (1 << zoom) - 1
    x0, y0 = tile_of(xmin, ymax, zoom)
    x1, y1 = tile_of(xmax, ymin, zoom)
    held = [F.greatest(F.lit(0), F.least(F.lit(last), v)) for v in (x0, y0, x1, y1)]
    return held[0], held[1], held[2], held[3]


def registry(spark: SparkSession, kind: str = "gsi") -> DataFrame:
    """The sources of a kind as a table: source, zoom, encoding, and priority from 0, the finest first."""
    rows = [(label, zoom, kind, k) for k, (label, zoom) in enumerate(REGISTRY[kind])]
    return spark.createDataFrame(rows, "source string, zoom int, encoding string, priority int")


def _candidates(extents: DataFrame, sources: DataFrame) -> DataFrame:
    """Every tile of every source that an extent (ext_id, xmin, ymin, xmax, ymax in degrees) touches, a row each."""
    known = [(r.zoom, r.source, r.priority) for r in sources.select("zoom", "source", "priority").toLocalIterator()]  # a few lines
    ranges = [F.struct(F.lit(source).alias("source"), F.lit(zoom).alias("zoom"), F.lit(priority).alias("priority"), *[v.alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), tile_range(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), zoom), strict=True)]) for zoom, source, priority in known]
    each = extents.select("ext_id", F.inline(F.array(*ranges)))
    return each.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("ty", F.explode(F.sequence("y0", "y1")))


def source_of_extents(extents: DataFrame, available: DataFrame, sources: DataFrame) -> DataFrame:
    """For each extent its source: the first by priority of which any tile with data touches it.

    ``available`` has the tiles with data (source, tx, ty). The result has ext_id, source,
    zoom, x0, y0, x1, y1 (first and last tile) and found, the tiles with data; nulls where no
    source has any. Each extent decides for itself, in one aggregation.
    """
    # Spark takes exploded rows for no more bytes than the extents have; a semi join never broadcasts its left side.
    met = _candidates(extents, sources).join(available.select("source", "tx", "ty").distinct(), ["source", "tx", "ty"], "left_semi")
    counted = met.groupBy("ext_id", "priority", "source", "zoom", "x0", "y0", "x1", "y1").agg(F.count("*").alias("found"))
    # Each extent's own row keeps it there without a tile: its null priority is passed over.
    each = counted.unionByName(extents.select("ext_id"), allowMissingColumns=True)
    return each.groupBy("ext_id").agg(F.min_by(F.struct("source", "zoom", "x0", "y0", "x1", "y1", "found"), "priority").alias("b")).select("ext_id", "b.*")


def finest_cover(extents: DataFrame, available: DataFrame, sources: DataFrame) -> DataFrame:
    """For each tile of the finest zoom that an extent touches, the finest source that has it or an ancestor of it.

    Tiles are a quadtree: an ancestor ``n`` zooms up has the tile's numbers divided by 2^n. The
    result has ext_id, tx, ty (finest zoom), source, zoom, sx, sy (the tile to read); tiles that
    no source covers have no row.
    """
    finest = sources.orderBy(F.desc("zoom")).limit(1)
    known = [(r.zoom, r.source, r.priority) for r in sources.select("zoom", "source", "priority").toLocalIterator()]
    top = max(zoom for zoom, _, _ in known)
    tiles = _candidates(extents, finest).select("ext_id", "tx", "ty")
    up = F.array(*[F.struct(F.lit(source).alias("source"), F.lit(zoom).alias("zoom"), F.lit(priority).alias("priority"), F.shiftright("tx", top - zoom).alias("sx"), F.shiftright("ty", top - zoom).alias("sy")) for zoom, source, priority in known])
    there = available.select("source", F.col("tx").alias("sx"), F.col("ty").alias("sy")).distinct()
    # As above, the exploded rows stay out of broadcasts.
    met = tiles.select("ext_id", "tx", "ty", F.inline(up)).join(there, ["source", "sx", "sy"], "left_semi")
    return met.groupBy("ext_id", "tx", "ty").agg(F.min_by(F.struct("source", "zoom", "sx", "sy"), "priority").alias("b")).select("ext_id", "tx", "ty", "b.*")


def years_summary(resolved: DataFrame) -> DataFrame:
    """One row of (code, year): the number of tiles and the distinct years as text, in order."""
    years = F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ", ")
    tiles = F.count("*")
    return resolved.agg(tiles.alias("tiles"), years.alias("years"), F.format_string("%d tile(s), year(s): %s", tiles, years).alias("text"))
