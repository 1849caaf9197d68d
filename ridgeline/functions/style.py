"""Colour ramps as column expressions: piecewise linear between stops, clamped outside."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stops of the fixed ramps, colours of the dynamic ones.
FIXED = {
    "stability_fs": [(0.0, (215, 25, 28)), (1.0, (245, 251, 182)), (2.0, (206, 234, 144)), (3.0, (166, 217, 106)), (4.0, (26, 150, 65))],
    "integrated_risk_index": [(0.0, (60, 180, 60)), (2.0, (255, 220, 0)), (3.0, (255, 130, 0)), (5.0, (200, 0, 0))],
}
DYNAMIC = {
    "tc": (False, [(255, 255, 220), (180, 210, 140), (50, 120, 50)]),
    "twi": (False, [(255, 255, 200), (70, 130, 230), (0, 50, 180)]),
    "flow_peak": (True, [(255, 235, 230), (220, 70, 40), (150, 0, 0)]),
    "flow_mean": (True, [(255, 240, 220), (235, 120, 30), (170, 50, 0)]),
    "flow_vtotal": (True, [(255, 228, 232), (210, 50, 80), (130, 0, 45)]),
}
#: Opacity of the three stops of a dynamic ramp by filter.
ALPHA = {"off": (255, 255, 255), "low": (0, 89, 255), "mid": (0, 0, 255)}


def ramp(value: Column, stops: list[tuple[Column, tuple[int, ...]]]) -> Column:
    """A struct r g b a; null for null. Channels are rounded down."""

    def channel(k: int) -> Column:
        at = [(v if isinstance(v, Column) else F.lit(float(v)), c[k]) for v, c in stops]
        out = F.when(value <= at[0][0], F.lit(float(at[0][1])))
        for (v0, c0), (v1, c1) in zip(at, at[1:], strict=False):
            out = out.when(value <= v1, c0 + (value - v0) / (v1 - v0) * (c1 - c0))
        return F.floor(out.otherwise(float(at[-1][1])) + 1e-6).cast("int")

    full = [(v, (*c, 255)[:4]) for v, c in stops]
    stops = full
    return F.when(value.isNotNull(), F.struct(*[channel(k).alias(n) for k, n in enumerate("rgba")]))


def dynamic_stops(name: str, low: Column, high: Column, opacity: str = "off") -> list[tuple[Column, tuple[int, ...]]]:
    """Three stops between the least and the greatest value; powers of ten for flows above 0."""
    log, colours = DYNAMIC[name]
    alpha = ALPHA[opacity] if name != "tc" else ALPHA["off"]
    out = []
    for i, colour in enumerate(colours):
        even = low + (high - low) * (i / 2)
        place = even if not log else F.when(low > 0, F.pow(F.lit(10.0), F.log10(low) + (F.log10(high) - F.log10(low)) * (i / 2))).otherwise(even)
        out.append((place, (*colour, alpha[i])))
    return out


def blur_sigma(mode: str) -> float:
    return {"weak": 2.0, "strong": 3.0}[mode]




#: Fill (r g b a) of a zone layer, and outlines as colour and width in mm or, negative, in pixels.
ZONES = {
    "valley_zones": ((30, 80, 220, 120), [((35, 35, 35, 255), 0.26), ((30, 80, 220, 52), -6.0)]),
    "unstable_zones": ((220, 0, 0, 140), []),
    "integrated_high_risk": ((200, 0, 0, 160), []),
}

#: The layers of a run by analysis: name, title, kind, suffix of its file; and the analyses' order, the lowest first.
LAYERS = [
    ("stability", "stability_fs", "Slope Stability FS", "raster", ".tif"),
    ("valley", "valley_zones", "Valley Terrain", "vector", ".gpkg"),
    ("wetland", "twi", "Wetland Terrain", "raster", ".tif"),
    ("flow", "flow_peak", "Peak Flow: Qp[m³/s]", "raster", ".tif"),
    ("flow", "flow_mean", "Mean Flow: Qm[m³/s]", "raster", ".tif"),
    ("flow", "flow_vtotal", "Total Flow Vol.: V[m³]", "raster", ".tif"),
    ("integrated", "integrated_risk_index", "Overall Risk Index", "raster", ".tif"),
    ("integrated", "integrated_high_risk", "High Risk Areas", "vector", ".gpkg"),
]
RANK = {"stability": 0, "integrated": 1, "wetland": 2, "valley": 3, "flow": 4}


def zone_fill(layer: Column) -> Column:
    """A struct r g b a, null for a layer without a style of its own."""
    out = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    for name, (fill, _) in ZONES.items():
        out = F.when(layer == name, F.struct(*[F.lit(v).alias(k) for v, k in zip(fill, "rgba", strict=True)])).otherwise(out)
    return out


def layer_table(spark: SparkSession) -> DataFrame:
    """analysis, layer, title, kind, suffix, rank: one row for each layer that a run can have."""
    return spark.createDataFrame([(*x, RANK[x[0]]) for x in LAYERS], "analysis string, layer string, title string, kind string, suffix string, rank int")


def describe_layers(layers: DataFrame, column: str = "layer") -> DataFrame:
    """Names of stored layers with what the table says of them; unknown ones are left out."""
    return layers.join(F.broadcast(layer_table(layers.sparkSession)).withColumnRenamed("layer", column), column)  # a row a layer
