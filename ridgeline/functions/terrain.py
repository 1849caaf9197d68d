"""Formulas of single cells, as column expressions. Null stands for nodata."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.operators.stencil import DIAGONAL


def at_least(x: Column, k: float) -> Column:
    """The larger of both; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(k)))


def wetness_index(accum: Column, slope: Column, cell: float) -> Column:
    return F.log(accum * (cell * cell) / F.tan(F.radians(at_least(slope, 0.1))))


def safety_factor(slope: Column, phi: float = 35.0, c: float = 0.0, z: float = 1.0, m: float = 0.5, gs: float = 18.0, gw: float = 9.81) -> Column:
    """Infinite slope; +Infinity where next to nothing drives it."""
    t = F.radians(slope)
    resisting = F.lit(c) + (gs - m * gw) * z * F.cos(t) * F.cos(t) * math.tan(math.radians(phi))
    driving = gs * z * F.sin(t) * F.cos(t)
    return F.when(slope.isNull(), None).when(driving > 1e-6, resisting / F.when(driving > 1e-6, driving)).otherwise(F.lit(math.inf))


def travel_hours(dzdx: Column, dzdy: Column, fdir: Column, cell: float, velocity: Column | float = 0.3, power: float = 0.5) -> Column:
    grade = at_least(F.sqrt(dzdx * dzdx + dzdy * dzdy), 0.001)
    speed = (velocity if isinstance(velocity, Column) else F.lit(velocity)) * F.pow(grade, power)
    step = F.when(fdir.isin(*DIAGONAL), cell * 1.4142).otherwise(cell)
    return step / speed / 3600.0


def hectares(accum: Column, cell: float) -> Column:
    return accum * (cell * cell) / 10000.0


def rational_flow(accum: Column, cell: float, rain: float = 50.0, runoff: float = 0.8) -> Column:
    return runoff * rain * hectares(accum, cell) / 360.0


def rational_metrics(accum: Column, cell: float, rain: float = 50.0, runoff: Column | float = 0.8, hours: float = 6.0, total: float = 100.0) -> tuple[Column, Column, Column]:
    """Peak, mean, volume."""
    area = hectares(accum, cell)
    mean = runoff * (total / max(hours, 0.1)) * area / 360.0
    return runoff * rain * area / 360.0, mean, mean * hours * 3600.0


def routed_metrics(accum: Column, tc: Column, cell: float, hours: float = 6.0, rain: float = 50.0, runoff: Column | float = 0.8, total: float = 100.0) -> tuple[Column, Column, Column]:
    """Peak, mean and volume of the area that contributes within the storm."""
    share = F.least(F.lit(1.0), hours / F.greatest(F.coalesce(tc, F.lit(1e-6)), F.lit(1e-6)))
    return rational_metrics(accum * share, cell, rain, runoff, hours, total)


def canopy_coefficients(height: Column) -> tuple[Column, Column]:
    """Runoff coefficient and velocity from canopy height, as floats; unknown counts as dense forest."""
    t = (F.greatest(F.lit(3.0), F.least(F.lit(10.0), F.coalesce(height, F.lit(10.0)))) - 3.0) / 7.0
    return (0.55 + t * (0.15 - 0.55)).cast("float"), (0.60 + t * (0.30 - 0.60)).cast("float")


def as_stored(x: Column) -> Column:
    """A value after its round trip through a 32-bit raster."""
    return x.cast("float").cast("double")


def additive_risk(fs: Column | None, twi: Column | None, flow: Column | None, fs_caution: float = 1.5, twi_caution: float = 8.0, flow_caution: float = 0.5) -> Column:
    """0 to 6; null where no layer has a value. Layers that weren't run are left out."""
    parts, known = [], []
    if fs is not None:
        parts.append(F.when(fs < 1.0, 3.0).when(fs < fs_caution, 2.0).otherwise(0.0))
        known.append(fs.isNotNull())
    if twi is not None:
        parts.append(F.when(twi >= twi_caution, 1.0).otherwise(0.0))
        known.append(twi.isNotNull())
    if flow is not None:
        parts.append(F.when(flow >= 2 * flow_caution, 2.0).when(flow >= flow_caution, 1.0).otherwise(0.0))
        known.append(flow.isNotNull())
    if not parts:
        raise FileNotFoundError("no layer to integrate")
    total, some = parts[0], known[0]
    for p, k in zip(parts[1:], known[1:], strict=True):
        total, some = total + p, some | k
    return F.when(some, total)


def multiplicative_risk(fs: Column | None, twi: Column | None, flow: Column | None, fs_caution: float = 1.5, twi_caution: float = 8.0, flow_caution: float = 0.5) -> Column:
    """1 to 32; a null factor is 1; null where no layer has a value."""
    parts, known = [], []
    if fs is not None:
        parts.append(F.when(fs < 1.0, 4.0).when(fs < fs_caution, 2.0).otherwise(1.0))
        known.append(fs.isNotNull())
    if twi is not None:
        parts.append(F.when(twi >= twi_caution, 2.0).otherwise(1.0))
        known.append(twi.isNotNull())
    if flow is not None:
        parts.append(F.when(flow >= 2 * flow_caution, 4.0).when(flow >= flow_caution, 2.0).otherwise(1.0))
        known.append(flow.isNotNull())
    if not parts:
        raise FileNotFoundError("no layer to integrate")
    total, some = parts[0], known[0]
    for p, k in zip(parts[1:], known[1:], strict=True):
        total, some = total * p, some | k
    return F.when(some, total)
