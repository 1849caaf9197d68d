"""Drainage trees: sums and longest times over all that drains through a cell.

The grid is cut into tiles of ``TILE`` x ``TILE`` cells. Within a tile paths are followed
at once; what crosses a border is a far smaller tree, of the cells whose receiver is in
another tile. Its sums and paths come from pointer doubling: in round k a pointer spans
2^k tiles' paths, so rounds are the logarithm of the tiles on the longest path, and each
ends in a table in the shared folder, so that a lost executor costs one round. A last
pass over the tiles adds what comes in from others. Cells are read two or three times,
whatever the length of paths. Steps always lead downhill: there is no cycle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.grid import GridMeta
from ridgeline.operators.stencil import D8
from ridgeline.storage import materialise, materialise_with

TILE = 256


def receiver(meta: GridMeta) -> Column:
    """The cell number that fdir leads to; null for code 0."""
    to = F.lit(None).cast("long")
    for code, dr, dc, _ in D8:
        to = F.when(F.col("fdir") == code, meta.id() + dr * meta.cols + dc).otherwise(to)
    return to


def tile_of(meta: GridMeta, cell: Column) -> Column:
    across = -(-meta.cols // TILE)
    return F.floor(F.floor(cell / meta.cols) / TILE) * across + F.floor((cell % meta.cols) / TILE)


class Tile:
    """The paths within one tile."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("_id").to_numpy()
        p = table.column("_p").fill_null(-1).to_numpy()
        order = np.argsort(self.ids)
        at = order[np.minimum(np.searchsorted(self.ids, p, sorter=order), len(order) - 1)]
        self.to = np.where((p >= 0) & (self.ids[at] == p), at, -1)
        self.out = np.where((p >= 0) & (self.to < 0), p, -1)  # the receiver in another tile
        self.root = np.where(self.to < 0, np.arange(len(p)), self.to)
        depth = (self.to >= 0).astype(np.int64)
        while True:
            ahead = self.root[self.root]
            if (ahead == self.root).all():
                break
            depth += depth[self.root]
            self.root = ahead
        order = np.argsort(-depth, kind="stable")
        #: The cells that drain to others here, farthest first, by number of steps.
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[: int(depth.max(initial=0))]

    def upstream(self, values: np.ndarray, gather: np.ufunc) -> np.ndarray:
        """Each cell's value gathered with those of all cells above it."""
        values = values.copy()
        for cells in self.levels:
            gather.at(values, self.to[cells], values[cells])
        return values

    def downstream(self, values: np.ndarray) -> np.ndarray:
        """Sums over each cell and all cells below it."""
        values = values.copy()
        for cells in reversed(self.levels):
            values[cells] += values[self.to[cells]]
        return values


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column of doubles, nulls as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy()


def _spread(tile: Tile, extra: pa.Table, name: str, empty: float) -> np.ndarray:
    """Values of a few cells at their places in the tile."""
    out = np.full(len(tile.ids), empty)
    order = np.argsort(tile.ids)
    values = _numbers(extra, name)
    known = ~np.isnan(values)
    out[order[np.searchsorted(tile.ids, extra.column("_id").to_numpy()[known], sorter=order)]] = values[known]
    return out


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~np.isfinite(values))


def _borders(cells: DataFrame, sums: list[str], time: str | None) -> DataFrame:
    """Of each tile the cells on its border: _id, exit (its receiver elsewhere), root (its path's last cell if that is an exit), sums and time to the end of the path here."""

    def scan(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        edge = np.flatnonzero((r % TILE == 0) | (r % TILE == TILE - 1) | (c % TILE == 0) | (c % TILE == TILE - 1))
        root = tile.root[edge]
        found = {
            "_id": pa.array(tile.ids[edge]),
            "exit": pa.array(tile.out[edge], mask=tile.out[edge] < 0),
            "root": pa.array(tile.ids[root], mask=tile.out[root] < 0),
        }
        found |= {s: pa.array(tile.upstream(np.nan_to_num(_numbers(table, s)), np.add)[edge]) for s in sums}
        if time:
            found["_below"] = _nullable(tile.downstream(_numbers(table, time))[edge])
        return pa.table(found)

    schema = "_id long, exit long, root long" + "".join(f", {s} double" for s in sums) + (", _below double" if time else "")
    return materialise(cells.select("tile", "_id", "_p", "r", "c", *sums, *([time] if time else [])).groupBy("tile").applyInArrow(scan, schema), "borders")


def doubled(state: DataFrame, up: dict[str, Callable], down: list[str], pointers: int | None = None) -> DataFrame:
    """Rows (id, p, values): ``up`` columns gathered over the row and all that lead to it (F.sum or F.max), ``down`` columns summed along its path.

    ``pointers`` tells how many rows of a written table have a p; without it the table is written first.
    """
    if pointers is None:
        state, seen = materialise_with(state, "rounds", live=F.count("p"))
        pointers = seen["live"]
    while pointers:
        live, done = state.filter("p IS NOT NULL"), state.filter("p IS NULL")
        ahead = state.select(F.col("id").alias("p"), F.col("p").alias("_p"), *[F.col(d).alias("_" + d) for d in down])
        moved = live.join(ahead, "p").select("id", F.col("_p").alias("p"), *up, *[(F.col(d) + F.col("_" + d)).alias(d) for d in down])
        moved = moved.unionByName(done)
        if up:
            gained = live.groupBy(F.col("p").alias("id")).agg(*[f(v).alias("_" + v) for v, f in up.items()])
            both = {v: F.greatest(v, "_" + v) if f is F.max else F.col(v) + F.coalesce("_" + v, F.lit(0.0)) for v, f in up.items()}
            moved = moved.join(gained, "id", "left").select("id", "p", *[x.alias(v) for v, x in both.items()], *down)
        state, seen = materialise_with(moved, "rounds", live=F.count("p"))
        pointers = seen["live"]
    return state


def _add(cells: DataFrame, extra: DataFrame, meta: GridMeta, added: list[str], work: Callable[[Tile, pa.Table, pa.Table], list[pa.Array]]) -> DataFrame:
    """The cells with the columns that ``work`` makes for a tile of them and the tile's rows of ``extra``."""
    names = cells.columns

    def scan(table: pa.Table, few: pa.Table) -> pa.Table:
        for name, column in zip(added, work(Tile(table), table, few), strict=True):
            table = table.append_column(name, column)
        return table

    schema = T.StructType([*cells.schema.fields, *[T.StructField(a, T.DoubleType()) for a in added]])
    few = extra.withColumn("tile", tile_of(meta, F.col("_id")))
    return cells.groupBy("tile").cogroup(few.groupBy("tile")).applyInArrow(scan, schema).select(*names, *added)


def drain(grid: DataFrame, meta: GridMeta, weights: list[str] | None = None, hours: str | None = None, accumulate: bool = True) -> DataFrame:
    """Adds accum, accum_<w> and, where ``hours`` is named, tc to a grid that has fdir."""
    weights, columns = weights or [], grid.columns
    sums = ["accum", *[f"accum_{w}" for w in weights]] if accumulate else []
    own = {"accum": F.lit(1.0)} | {f"accum_{w}": F.col(w).cast("double") for w in weights}
    cells = grid.select("*", meta.id().alias("_id"), receiver(meta).alias("_p"), *[own[s].alias("_" + s) for s in sums], *([F.col(hours).cast("double").alias("_hours")] if hours else []))
    cells = cells.withColumn("tile", tile_of(meta, F.col("_id")))
    inner, time = ["_" + s for s in sums], "_hours" if hours else None
    border = _borders(cells, inner, time)
    exits = border.filter("exit IS NOT NULL").drop("root", "_below")
    entries = border.select(F.col("_id").alias("exit"), "root", *(["_below"] if time else []))
    # An exit leads to the exit that its receiver's path ends in.
    tree, seen = materialise_with(exits.join(entries, "exit").select(F.col("_id").alias("id"), F.col("root").alias("p"), "exit", *inner, *(["_below"] if time else [])), "exits", live=F.count("p"))
    totals = doubled(tree.drop("exit"), {s: F.sum for s in inner}, ["_below"] if time else [], seen["live"])
    arrived = totals.join(tree.select("id", "exit"), "id").groupBy(F.col("exit").alias("_id")).agg(*[F.sum(s).alias(s) for s in inner], F.lit(None).cast("double").alias("_below"), F.lit(None).cast("boolean").alias("_cut")) if sums else None
    known = [F.lit(None).cast("double").alias(s) for s in inner]
    extra = totals.select(F.col("id").alias("_id"), *known, "_below", F.col("_below").isNull().alias("_cut")) if time else None
    extra = arrived if extra is None else extra if arrived is None else arrived.unionByName(extra).groupBy("_id").agg(*[F.max(s).alias(s) for s in inner], F.max("_below").alias("_below"), F.max("_cut").alias("_cut"))

    def total(tile: Tile, table: pa.Table, few: pa.Table) -> list[pa.Array]:
        found = [pa.array(tile.upstream(np.nan_to_num(_numbers(table, s)) + _spread(tile, few, s, 0.0), np.add)) for s in inner]
        if time:
            below = _spread(tile, few, "_below", 0.0)
            cut = few.column("_cut").fill_null(False).to_numpy(zero_copy_only=False)
            below[np.isin(tile.ids, few.column("_id").to_numpy()[cut])] = np.nan
            cum = tile.downstream(_numbers(table, time)) + below[tile.root]
            found += [_nullable(cum), _nullable(tile.upstream(np.where(np.isnan(cum), -np.inf, cum), np.maximum))]
        return found

    out = _add(cells, extra, meta, [*sums, *(["_cum", "_most"] if time else [])], total)
    if not time:
        return out.select(*columns, *sums)
    out = materialise(out.drop(*inner), "times")
    late = doubled(tree.select("id", "p").join(out.select(F.col("_id").alias("id"), "_most"), "id"), {"_most": F.max}, [])
    late = late.join(tree.select("id", "exit"), "id").groupBy(F.col("exit").alias("_id")).agg(F.max("_most").alias("_late"))

    def longest(tile: Tile, table: pa.Table, few: pa.Table) -> list[pa.Array]:
        cum = _numbers(table, "_cum")
        most = tile.upstream(np.maximum(np.where(np.isnan(cum), -np.inf, cum), _spread(tile, few, "_late", -np.inf)), np.maximum)
        return [_nullable(np.where(np.isnan(cum), np.nan, most - cum))]

    return _add(out, late, meta, ["tc"], longest).select(*columns, *sums, "tc")


def flow_accumulation(grid: DataFrame, meta: GridMeta, weights: list[str] | None = None) -> DataFrame:
    """Adds accum (cells that drain through the cell, itself included) and accum_<w> for weights; null weights count 0.

    Cells without data keep 1, or their weight.
    """
    return drain(grid, meta, weights)


def concentration_hours(grid: DataFrame, meta: GridMeta, hours: str = "hours") -> DataFrame:
    """Adds tc: from the cell's own time to the outlet back to the longest upstream.

    A cell without a time of its own makes all cells above it null; nulls never count.
    """
    return drain(grid, meta, hours=hours, accumulate=False)
