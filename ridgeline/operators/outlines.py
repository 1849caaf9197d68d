"""Outlines of zones, traced by tiles and put together from a table of their parts.

A zone's border is made of sides of cells, each with the zone at its right hand. The side
that follows one is known from the three cells around its end, so every tile (with a rim
of one cell) links its own sides and follows them as far as it reaches: a part of a ring
is a run of sides within a tile. What follows a part is a part of a neighbouring tile, so
the rings are cycles of parts; their least side and each part's place in its ring come
from pointers that double in each round. No task holds more than a tile, whatever a
zone's size, and rounds are as many as the logarithm of a ring's parts.

Zones are cells (r, c, zone) that needn't be connected. Where two cells of a zone touch
at a corner alone, rings turn right there, so they never cross. Cells of no zone have no
row; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.storage import materialise, materialise_with

#: Cells along a tile's edge.
TILE = 256
#: Which way a side faces: up, right, down, left. A side is walked in the direction that the next one faces.
_FACING = ((-1, 0), (0, 1), (1, 0), (0, -1))
#: Where a side ends, from its cell's first corner.
_ENDS = ((0, 1), (1, 1), (1, 0), (0, 0))


def _near(k: Column, tile: int) -> Column:
    """Tiles whose rim or inside has the row or column."""
    at = lambda v: F.floor(v / tile).cast("int")
    return F.array_distinct(F.array(at(k - 1), at(k), at(k + 1)))


def _links(zone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sides of a tile's own cells (row, column, facing) and the sides after them (cell steps and facing).

    ``zone`` has a rim of one cell; 0 is no zone.
    """
    inside = zone[1:-1, 1:-1]
    shift = lambda dr, dc: zone[1 + dr : zone.shape[0] - 1 + dr, 1 + dc : zone.shape[1] - 1 + dc] == inside
    found = []
    for d, (dr, dc) in enumerate(_FACING):
        hr, hc = _FACING[(d + 1) % 4]
        border = (inside > 0) & ~shift(dr, dc)
        ahead, across = shift(hr, hc), shift(hr + dr, hc + dc)
        r, c = np.nonzero(border)
        # Right where nothing is ahead; left where the cell across goes on; else straight.
        right, left = ~ahead[r, c], ahead[r, c] & across[r, c]
        after = np.where(right, (d + 1) % 4, np.where(left, (d + 3) % 4, d))
        step_r, step_c = np.where(right, 0, np.where(left, hr + dr, hr)), np.where(right, 0, np.where(left, hc + dc, hc))
        found.append((r, c, np.full(len(r), d), r + step_r, c + step_c, after))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(after: list[int]) -> Iterator[list[int]]:
    """Runs of linked places; -1 leads out. Those that nothing in here leads to come first, then the closed ones."""
    led = set(after)
    seen = bytearray(len(after))
    for start in [k for k in range(len(after)) if k not in led] + list(range(len(after))):
        if seen[start]:
            continue
        run = []
        while start >= 0 and not seen[start]:
            seen[start] = 1
            run.append(start)
            start = after[start]
        yield run


_PART = "zone long, head long, next long, low long, across int, along int, area2 long, cr array<int>, cc array<int>"


def _traced(meta: GridMeta, tile: int):
    cols = meta.cols

    def trace(table: pa.Table) -> pa.Table:
        r0, c0 = table.column("tr")[0].as_py() * tile, table.column("tc")[0].as_py() * tile
        zone = np.zeros((tile + 2, tile + 2), np.int64)
        # 0 stands for no zone, and zones may have any number.
        names, codes = np.unique(table.column("zone").to_numpy(), return_inverse=True)
        zone[table.column("r").to_numpy() - r0 + 1, table.column("c").to_numpy() - c0 + 1] = codes + 1
        r, c, d, nr, nc, nd = _links(zone)
        place = np.full((4, tile, tile), -1, np.int64)
        place[d, r, c] = np.arange(len(r))
        here = (nr >= 0) & (nr < tile) & (nc >= 0) & (nc < tile)
        after = np.full(len(r), -1, np.int64)
        after[here] = place[nd[here], nr[here], nc[here]]
        name = ((r + r0) * cols + c + c0) * 4 + d
        follower = ((nr + r0) * cols + nc + c0) * 4 + nd
        er, ec = (np.array([e[k] for e in _ENDS])[d] + x + x0 for k, x, x0 in ((0, r, r0), (1, c, c0)))
        hr, hc = (np.array([_FACING[(k + 1) % 4][i] for k in range(4)])[d] for i in (0, 1))
        twice = (ec - hc) * er - ec * (er - hr)
        out = {k: [] for k in ("zone", "head", "next", "low", "across", "along", "area2", "cr", "cc")}
        for run in _runs(after.tolist()):
            at = np.array(run)
            if after[at[-1]] >= 0:  # closed: it starts with its least side, as rings of many parts do
                at = np.roll(at, -int(name[at].argmin()))
            turn = at[nd[at] != d[at]]
            out["zone"].append(names[zone[r[at[0]] + 1, c[at[0]] + 1] - 1])
            out["head"].append(name[at[0]])
            out["next"].append(follower[at[-1]])
            out["low"].append(name[at].min())
            out["across"].append(int((d[at] % 2 == 0).sum()))
            out["along"].append(int((d[at] % 2 == 1).sum()))
            out["area2"].append(int(twice[at].sum()))
            out["cr"].append(er[turn])
            out["cc"].append(ec[turn])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return trace


def _least(parts: DataFrame) -> DataFrame:
    """head, ring: the least side of each part's ring."""
    state, live = parts.select("head", F.col("next").alias("p"), F.col("low").alias("ring")), 1
    while live:
        other = state.select(F.col("head").alias("p"), F.col("p").alias("p2"), F.col("ring").alias("ring2"))
        moved = state.join(other, "p").select("head", F.col("p2").alias("p"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("live"))
        # A round that lowers nothing has seen every ring whole.
        state, seen = materialise_with(moved, "ring-least", live=F.count(F.when(F.col("live"), 1)))
        state, live = state.drop("live"), seen["live"]
    return state.select("head", "ring")


def _placed(parts: DataFrame) -> DataFrame:
    """Parts with ring and place: the ring is cut after the part that holds its least side, and parts count what follows."""
    ringed = materialise(parts.join(_least(parts), "head"), "ring-parts")
    state, live = ringed.select("head", F.when(F.col("low") != F.col("ring"), F.col("next")).alias("p"), F.lit(1).cast("long").alias("left")), 1
    while live:
        other = state.select(F.col("head").alias("p"), F.col("p").alias("p2"), F.col("left").alias("left2"))
        moved = state.join(other, "p", "left").select("head", F.col("p2").alias("p"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))
        state, seen = materialise_with(moved, "ring-places", live=F.count("p"))
        live = seen["live"]
    return ringed.join(state.select("head", (-F.col("left")).alias("place")), "head")


def ring_parts(zones: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """zone, ring, place, across, along, area2, cr, cc: the parts of each ring, in order of place.

    ``ring`` is the number of its least side (cell number times 4, and 0 to 3 for up, right,
    down, left). ``across`` and ``along`` count sides along rows and columns, ``area2`` is
    twice the part's share of the ring's area in cells: rings around a zone have a positive
    area, holes a negative one. ``cr`` and ``cc`` are the corners, in the order of the walk.
    """
    spread = zones.select("zone", "r", "c", F.explode(_near(F.col("r"), tile)).alias("tr"), "c").select("zone", "r", "c", "tr", F.explode(_near(F.col("c"), tile)).alias("tc"))
    parts = materialise(spread.filter("tr >= 0 AND tc >= 0").groupBy("tr", "tc").applyInArrow(_traced(meta, tile), _PART), "outline-parts")
    closed = parts.filter("next = head").withColumns({"ring": F.col("head"), "place": F.lit(-1).cast("long")})
    open_ = parts.filter("next <> head")
    names = ["zone", "ring", "place", "across", "along", "area2", "cr", "cc"]
    return closed.select(*names).unionByName(_placed(open_).select(*names))


def zone_rings(parts: DataFrame, meta: GridMeta) -> DataFrame:
    """One row per ring of ``ring_parts``: zone, ring, corners, perimeter, area (negative for holes)."""
    sums = parts.groupBy("zone", "ring").agg(F.sum(F.size("cr")).alias("corners"), F.sum("across").alias("across"), F.sum("along").alias("along"), F.sum("area2").alias("area2"))
    return sums.select("zone", "ring", "corners", (F.col("across") * abs(meta.px) + F.col("along") * abs(meta.py)).alias("perimeter"), (F.col("area2") * (abs(meta.px * meta.py) / 2)).alias("area"))


def ring_corners(parts: DataFrame, meta: GridMeta) -> DataFrame:
    """A row per corner of ``ring_parts``, in coordinates: zone, ring, place, k, x, y; a ring is in order of place and k."""
    each = parts.select("zone", "ring", "place", F.posexplode(F.arrays_zip("cr", "cc")).alias("k", "at"))
    return each.select("zone", "ring", "place", "k", (F.lit(meta.x0) + F.col("at.cc") * meta.px).alias("x"), (F.lit(meta.y0) + F.col("at.cr") * meta.py).alias("y"))


def zone_outlines(zones: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """One row per zone: zone, value 1 and its polygons with their holes as WKT.

    The text of one zone is one value, whose corners meet in the task that joins it; where
    that is too long, ``ring_corners`` has the same as rows. A zone that isn't connected, and
    one whose parts touch at corners alone, has a ring around each part after the first.
    """
    x0, px, y0, py = meta.x0, meta.px, meta.y0, meta.py

    @F.arrow_udf("string")
    def text(rows: pa.Array, cols: pa.Array) -> pa.Array:
        out = []
        for r, c in zip(rows.to_pylist(), cols.to_pylist(), strict=True):
            out.append(", ".join(f"{x0 + b * px:.10g} {y0 + a * py:.10g}" for a, b in zip(r, c, strict=True)))
        return pa.array(out, pa.string())

    texts = ring_parts(zones, meta, tile).withColumn("text", text("cr", "cc"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
    rings = texts.groupBy("zone", "ring").agg(F.array_join(F.filter(ordered, lambda t: t != ""), ", ").alias("body"), F.sum("area2").alias("area2"))
    # A ring ends where it starts. The rings around a zone come first, the largest before others.
    closed = rings.select("zone", (-F.col("area2")).alias("o"), "ring", F.concat(F.lit("("), "body", F.lit(", "), F.substring_index("body", ", ", 1), F.lit(")")).alias("body"))
    joined = closed.groupBy("zone").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "ring", "body"))), lambda p: p["body"]), ", ").alias("body"))
    return joined.select("zone", F.lit(1).alias("value"), F.concat(F.lit("POLYGON ("), "body", F.lit(")")).alias("wkt"))
