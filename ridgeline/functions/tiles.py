"""Elevation tiles and survey tile codes, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_WORLD = 20037508.3428
TILE_WIDTH, TILE_HEIGHT = 400, 300
#: Elevation tile sources in order of resolution, by encoding: label and zoom (fixed values).
REGISTRY = {"gsi": (("DEM1A 1m", 17), ("DEM5A 5m", 15), ("DEM10B 10m", 14)), "terrarium": (("Terrarium ~2m", 14), ("Terrarium ~5m", 13), ("Terrarium ~10m", 12))}
MAX_PIXELS = 100_000_000


def decode_gsi(r: Column, g: Column, b: Column) -> Column:
    """Metres from a signed 24-bit number of centimetres; 0x800000 is nodata."""
    u = r * 65536 + g * 256 + b
    return F.when(u < 0x800000, u * F.lit(0.01)).when(u > 0x800000, (u - 0x1000000) * F.lit(0.01))


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    phi = F.radians(lat)
    x = ((lon + 180.0) / 360.0 * n).cast("long")
    y = ((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n).cast("long")
    return x, y


def tile_corner(tx: Column, ty: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's upper left corner."""
    n = float(1 << zoom)
    return tx / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * ty / n))))


def tile_transform(tx: Column, ty: Column, zoom: int) -> tuple[Column, Column, Column]:
    """x0, y0 and pixel size in Web Mercator metres."""
    size = 2 * HALF_WORLD / (1 << zoom)
    return -HALF_WORLD + tx * size, HALF_WORLD - ty * size, F.lit(size / 256)


def folder_origin(folder: Column) -> tuple[Column, Column]:
    x = (F.ascii(F.substring(folder, 2, 1)) - ord("E")) * 40000
    y = -(F.ascii(F.substring(folder, 1, 1)) - ord("M") + 2) * 30000
    return x, y


def code_extent(code: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax of a tile code ``08`` folder XX AA."""
    x0, y0 = folder_origin(F.substring(code, 3, 2))
    d = [F.substring(code, k, 1).cast("int") for k in (5, 6, 7, 8)]
    xmin = x0 + d[1] * 4000 + d[3] * TILE_WIDTH
    ymax = y0 - d[0] * 3000 - d[2] * TILE_HEIGHT
    return xmin, ymax - TILE_HEIGHT, xmin + TILE_WIDTH, ymax
