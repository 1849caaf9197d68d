"""The whole analysis of an elevation grid as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import terrain as t
from ridgeline.grid import GridMeta
from ridgeline.operators.drainage import drain, flow_accumulation
from ridgeline.operators.stencil import direction_of, gradients, slope_of, surface_complexity
from ridgeline.storage import materialise


@dataclass(frozen=True)
class AnalysisParams:
    """What a run can be asked for, with its defaults."""

    stability: bool = True
    valley: bool = True
    flow: bool = False
    phi_deg: float = 35.0
    c_kpa: float = 0.0
    z_m: float = 1.0
    m_sat: float = 0.5
    fs_thresh: float = 1.5
    twi_thresh: float = 8.0
    min_area: float = 1000.0
    rainfall_mmh: float = 50.0
    runoff: float = 0.8
    total_mm: float = 100.0
    duration_h: float = 6.0
    velocity_coef: float = 0.3
    flow_caution: float = 0.5
    high_risk: float = 3.0
    mask_nodata: bool = False

    def manifest(self, dem_path: str) -> dict:
        """The values of the analyses that were chosen, and no others."""
        out: dict = {"dem_path": dem_path, "analyses": [k for k in ("flow", "stability", "valley") if getattr(self, k)]}
        keys = {"flow": ("duration_h", "rainfall_mmh", "total_mm", "runoff", "velocity_coef"), "stability": ("phi_deg", "c_kpa", "z_m", "m_sat", "fs_thresh"), "valley": ("twi_thresh", "min_area")}
        return out | {k: getattr(self, k) for a in out["analyses"] for k in keys[a]}


def terrain(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """Adds gradients, slope and direction, all from one pair of window passes."""
    near = gradients(grid, meta)
    return near.withColumns({"slope": slope_of(F.col("dzdx"), F.col("dzdy")), "fdir": direction_of()}).select(*grid.columns, "dzdx", "dzdy", "slope", "fdir")


def drained(grid: DataFrame, meta: GridMeta, weights: list[str] | None = None) -> DataFrame:
    """terrain() and accumulation; the first is a table, as drainage reads it twice."""
    return flow_accumulation(materialise(terrain(grid, meta), "terrain"), meta, weights)


def analyse(grid: DataFrame, meta: GridMeta, params: AnalysisParams | None = None, canopy: str | None = None) -> DataFrame:
    """All layers of a run as columns of one row a cell, so that no layers are joined.

    ``canopy`` names a column of canopy height; it then gives runoff and velocity.
    """
    p = params or AnalysisParams()
    if not (p.stability or p.valley or p.flow):
        raise ValueError("choose an analysis")
    cells = surface_complexity(grid, meta)
    runoff, weights = F.lit(p.runoff), []
    speed = F.lit(p.velocity_coef)
    if canopy:
        c, v = t.canopy_coefficients(F.col(canopy))
        cells = cells.withColumns({"c_coef": c.cast("double"), "v_coef": v.cast("double")})
        weights, speed = ["c_coef"], F.col("v_coef")
    cells = terrain(cells, meta)
    if p.flow:
        cells = cells.withColumn("hours", t.travel_hours(F.col("dzdx"), F.col("dzdy"), F.col("fdir"), meta.cell, speed))
    cells = drain(materialise(cells, "terrain"), meta, weights, hours="hours" if p.flow else None)
    if canopy:
        runoff = F.col("accum_c_coef") / F.greatest(F.col("accum"), F.lit(1.0))
    layers = {}
    if p.stability:
        layers["stability_fs"] = t.safety_factor(F.col("slope"), p.phi_deg, p.c_kpa, p.z_m, p.m_sat)
    if p.valley:
        layers["twi"] = t.wetness_index(F.col("accum"), F.col("slope"), meta.cell)
    cells = cells.withColumns(layers)
    if p.flow:
        peak, mean, volume = t.routed_metrics(F.col("accum"), F.col("tc"), meta.cell, p.duration_h, p.rainfall_mmh, runoff, p.total_mm)
        known = F.col("z").isNotNull() if p.mask_nodata else F.lit(True)
        cells = cells.withColumns({"flow_peak": F.when(known, peak), "flow_mean": F.when(known, mean), "flow_vtotal": F.when(known, volume)})
    stored = {k: t.as_stored(F.col(k)) for k in ("stability_fs", "twi", "flow_peak") if k in cells.columns}
    layer = [stored.get(k) for k in ("stability_fs", "twi", "flow_peak")]
    risk = t.additive_risk(*layer, fs_caution=p.fs_thresh, twi_caution=p.twi_thresh, flow_caution=p.flow_caution)
    cells = cells.withColumn("integrated_risk_index", risk)
    masks = {"high_risk": F.col("integrated_risk_index") >= p.high_risk}
    if p.stability:
        masks["unstable"] = F.col("stability_fs") < p.fs_thresh
    if p.valley:
        masks["valley"] = (F.col("twi") >= p.twi_thresh) & (F.col("accum") >= p.min_area / meta.cell**2)
    return cells.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in masks.items()}).drop("dzdx", "dzdy")
