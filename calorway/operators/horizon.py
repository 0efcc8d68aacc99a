"""Shade horizons: 72 rays per sample, as spatial joins.

opaque[b]  highest building angle in degrees along azimuth 5b
canopy[b]  highest angle at which a crown still intercepts the beam
tau_q[b]   transmitted share of the beam at 30 degrees, in 1/255
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (AZIMUTH_BINS, BIN_WIDTH_DEG, EYE_HEIGHT_M, RAY_CAP_M,
                         TAU_ELEVATION_DEG, TAU_FLOOR)
from ..functions.geometry import bounds, point_segment_distance, ring_area, segments
from ..session import materialize
from .cells import CELL_KEYS, box_cells, cell_join, point_cells, salted
from .rays import JUST_UNDER, Spans, march, turns

CELL_M = 200.0
FOOTPRINT_CELL_M = 100.0
TOUCH_M = 0.01
OUTLINE_M = 1e-9
BLOCKED_RATIO = 1e30
EDGE_SLACK = 1e-9
#: rows of one id in the same square of this size are one sample
PLACE_M = 200.0
#: cells of horizons: what rays can reach from a cell is four times the cell, and larger cells repeat it less often
HORIZON_CELL_M = 800.0
#: lanes about as wide as what they hold
WALL_LANE_M, CROWN_LANE_M = 32.0, 16.0
#: pairs of a direction with a sample, or with an obstacle, that a task looks at in one go, and pairs of both from which on a cell is split
PAIRS_AT_ONCE = 60_000
PAIRS_PER_CELL = 50_000_000

# twelve decimals make the axis rays exactly axis-aligned
_EAST = np.array([round(math.sin(math.radians(b * BIN_WIDTH_DEG)), 12) for b in range(AZIMUTH_BINS)])
_NORTH = np.array([round(math.cos(math.radians(b * BIN_WIDTH_DEG)), 12) for b in range(AZIMUTH_BINS)])


def walls(buildings: DataFrame) -> DataFrame:
    """One row per wall, with the solid on the left of a -> b.

    Outer rings are turned counter-clockwise and holes clockwise first.
    """
    ring = F.col("ring")
    turn = (F.col("ring_no") == 0) != (ring_area(ring) > 0.0)
    rings = buildings.select("building_id", "height_m", F.posexplode("rings").alias("ring_no", "ring"))
    oriented = rings.withColumn("ring", F.when(turn, F.reverse(ring)).otherwise(ring))
    wall = F.explode(segments(ring)).alias("w")
    return (oriented.select("building_id", F.col("height_m").cast("double").alias("height_m"), wall)
            .select("building_id", "height_m", F.col("w.a.x").alias("ax"), F.col("w.a.y").alias("ay"),
                    F.col("w.b.x").alias("bx"), F.col("w.b.y").alias("by"))
            .filter("ax <> bx OR ay <> by"))


def samples_inside(samples: DataFrame, buildings: DataFrame) -> DataFrame:
    """Distinct sample_id standing in some footprint or on its outline."""
    x0, y0, x1, y1 = bounds(F.col("rings")[0])
    boxes = buildings.select(
        "building_id", F.flatten(F.transform("rings", segments)).alias("segs"),
        x0.alias("bx0"), y0.alias("by0"), x1.alias("bx1"), y1.alias("by1"))
    boxes = box_cells(boxes, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), FOOTPRINT_CELL_M)
    points = point_cells(samples.select("sample_id", "x_m", "y_m"), "x_m", "y_m", FOOTPRINT_CELL_M)
    x, y = F.col("x_m"), F.col("y_m")
    near = x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
    sides = cell_join(points, boxes, "sample_id", near).select(
        *CELL_KEYS, "sample_id", "building_id", "x_m", "y_m", F.explode("segs").alias("s"))
    ax, ay, bx, by = F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")
    # even-odd rule over all rings, holes included
    crossed = ((ay > y) != (by > y)) & (x < ax + F.try_divide((bx - ax) * (y - ay), by - ay))
    touched = point_segment_distance(x, y, ax, ay, bx, by) <= OUTLINE_M
    verdict = sides.groupBy(*CELL_KEYS, "sample_id", "building_id").agg(
        (F.count_if(crossed) % 2 == 1).alias("within"), F.bool_or(touched).alias("touched"))
    return verdict.filter("within OR touched").select("sample_id").distinct()


def _angles(ratio: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.degrees(np.arctan(ratio)), 0.0, 90.0))


def _floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles; a null is not a number and meets nothing."""
    return [table.column(n).to_numpy(zero_copy_only=False).astype("float64") for n in names]


def _slots(points: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(ids, which of them each row has): rows with the same id and near place are one sample."""
    codes = points.column("sample_id").combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.floor(np.stack(_floats(points, "x_m", "y_m")) / PLACE_M)
    keys = np.concatenate([codes.indices.to_numpy(zero_copy_only=False)[None].astype("float64"), np.nan_to_num(place, nan=np.inf)])
    distinct, slot = np.unique(keys, axis=1, return_inverse=True)
    return codes.dictionary.take(pa.array(distinct[0].astype("int64"))), slot.reshape(-1)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of 72 values as lists of short."""
    offsets = np.arange(0, values.size + 1, AZIMUTH_BINS, dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).astype("int16")))


def _per_sample(values: np.ndarray, slot: np.ndarray, count: int, fold) -> np.ndarray:
    """Rows of 72 values folded into one row per sample; most often a sample has one row."""
    out = np.full((count, AZIMUTH_BINS), -np.inf if fold is np.fmax else 0.0)
    fold.at(out, slot, values)
    return out


def _placed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows with a place; no ray leaves from the others."""
    return np.flatnonzero(np.isfinite(x) & np.isfinite(y))


def _opaque_of_cell(points: pa.Table, walls: pa.Table) -> pa.Table:
    """(sample_id, opaque) of one cell's samples; a ray meets facing walls only."""
    ids, slot = _slots(points)
    x, y = _floats(points, "x_m", "y_m")
    height, ax, ay, bx, by = _floats(walls, "height_m", "ax", "ay", "bx", "by")
    solid = np.flatnonzero(np.isfinite(ax) & np.isfinite(ay) & np.isfinite(bx) & np.isfinite(by))
    height, ax, ay, bx, by = (c[solid] for c in (height, ax, ay, bx, by))
    ex, ey = bx - ax, by - ay
    best = np.full((len(x), AZIMUTH_BINS), -np.inf)
    placed = _placed(x, y)
    for part in _parts(placed) if len(ax) else ():
        px, py = x[part], y[part]
        cx, cy = px.mean(), py.mean()
        for turn in turns(PAIRS_AT_ONCE, len(part), len(ax)):
            dx, dy = _EAST[turn], _NORTH[turn]

            def meet(t, i, j):
                rx, ry = ax[j] - px[i], ay[j] - py[i]
                exj, eyj, east, north = ex[j], ey[j], dx[t], dy[t]
                den = east * eyj - north * exj
                along = (rx * eyj - ry * exj) / den
                share = (rx * north - ry * east) / den
                hit = (exj * ry - eyj * rx > 0.0) & (along >= 0.0) & (along <= RAY_CAP_M) & (share >= -EDGE_SLACK) & (share <= 1.0 + EDGE_SLACK)
                ratio = np.where(along <= TOUCH_M, BLOCKED_RATIO, (height[j] - EYE_HEIGHT_M) / along)
                return np.where(hit, ratio, -np.inf)

            along, across = _turned(px - cx, py - cy, dx, dy)
            spans = _wall_spans(ax - cx, ay - cy, bx - cx, by - cy, ex, ey, dx, dy)
            best[part, turn] = march(spans, height, along, across, WALL_LANE_M, TOUCH_M, np.inf, meet).T
    opaque = _angles(_per_sample(best, slot, len(ids), np.fmax))
    opaque[slot[points.column("inside").to_numpy(zero_copy_only=False).astype(bool)]] = 90
    return pa.table({"sample_id": ids, "opaque": _lists(opaque)})


def _parts(placed: np.ndarray):
    """Rows in parts whose rays of one direction fit the memory of a task."""
    return (placed[i:i + PAIRS_AT_ONCE] for i in range(0, len(placed), PAIRS_AT_ONCE))


def _turned(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(metres along, metres across) some directions, one row per direction."""
    return np.outer(dx, x) + np.outer(dy, y), np.outer(dy, x) - np.outer(dx, y)


def _wall_spans(ax, ay, bx, by, ex, ey, dx, dy) -> Spans:
    """Walls seen along some directions, those that face the rays; across a ray they grow from a to b."""
    den = dx[:, None] * ey - dy[:, None] * ex
    t, j = np.nonzero(den < 0.0)
    ua, va = ax[j] * dx[t] + ay[j] * dy[t], ax[j] * dy[t] - ay[j] * dx[t]
    ub, vb = bx[j] * dx[t] + by[j] * dy[t], bx[j] * dy[t] - by[j] * dx[t]
    # a ray may pass an end by a share of the wall
    room = EDGE_SLACK * (np.abs(ex) + np.abs(ey))[j]
    with np.errstate(divide="ignore", over="ignore"):
        grade = (ub - ua) / -den[t, j]
    return Spans(t, j, va - room, np.maximum(va, vb) + room, ua, grade, np.minimum(ua, ub) - room, np.maximum(ua, ub) + room)


def _crown_spans(tx, ty, radius, dx, dy) -> Spans:
    """Crowns seen along some directions; what counts is how far along the trunk stands."""
    u, v = _turned(tx, ty, dx, dy)
    t, j = np.divmod(np.arange(u.size), len(tx))
    u, v, r = u.ravel(), v.ravel(), radius[j]
    return Spans(t, j, v - r, v + r, u, np.zeros(len(u)), u, u)


def _canopy_of_cell(points: pa.Table, crowns: pa.Table) -> pa.Table:
    """(sample_id, canopy, tau_q) of one cell's samples."""
    ids, slot = _slots(points)
    x, y = _floats(points, "x_m", "y_m")
    tx, ty, radius, base, top, tau = _floats(crowns, "tx", "ty", "crown_radius_m", "crown_base_m", "crown_top_m", "tau")
    standing = np.flatnonzero(np.isfinite(tx) & np.isfinite(ty) & (radius >= 0.0))
    tx, ty, radius, base, top, tau = (c[standing] for c in (tx, ty, radius, base, top, tau))
    log_tau, slope = np.log(np.fmax(tau, TAU_FLOOR)), math.tan(math.radians(TAU_ELEVATION_DEG))
    best, dimmed = np.full((len(x), AZIMUTH_BINS), -np.inf), np.zeros((len(x), AZIMUTH_BINS))
    placed = _placed(x, y)
    for part in _parts(placed) if len(tx) else ():
        px, py = x[part], y[part]
        cx, cy = px.mean(), py.mean()
        for turn in turns(PAIRS_AT_ONCE, len(part), len(tx)):
            dx, dy = _EAST[turn], _NORTH[turn]

            def meet(t, i, j):
                gx, gy, east, north = tx[j] - px[i], ty[j] - py[i], dx[t], dy[t]
                along = gx * east + gy * north
                hit = np.flatnonzero((np.abs(gx * north - gy * east) <= radius[j]) & (along > 0.0) & (along <= RAY_CAP_M))
                along, crown = along[hit], j[hit]
                ratio = np.full(len(j), -np.inf)
                ratio[hit] = (top[crown] - EYE_HEIGHT_M) / np.maximum(along, 0.01)
                height = along * slope + EYE_HEIGHT_M
                band = (base[crown] <= height) & (height <= top[crown])
                # a ray is here once
                dimmed[part[i[hit[band]]], turn.start + t[hit[band]]] += log_tau[crown[band]]
                return ratio

            along, across = _turned(px - cx, py - cy, dx, dy)
            best[part, turn] = march(_crown_spans(tx - cx, ty - cy, radius, dx, dy), top, along, across, CROWN_LANE_M, 0.01, slope * JUST_UNDER, meet).T
    shares = np.rint(np.minimum(np.exp(_per_sample(dimmed, slot, len(ids), np.add)), 1.0) * 255.0)
    return pa.table({"sample_id": ids, "canopy": _lists(_angles(_per_sample(best, slot, len(ids), np.fmax))), "tau_q": _lists(shares)})


def _by_cell(points: DataFrame, others: DataFrame, of_cell, columns: str) -> DataFrame:
    """One row per sample: `of_cell` gets the samples of a cell and all that their rays can reach, hot cells in salted parts."""
    points, others = salted(points, others, "sample_id", PAIRS_PER_CELL)
    kind = points.schema["sample_id"].dataType.simpleString()
    return points.groupBy(*CELL_KEYS).cogroup(others.groupBy(*CELL_KEYS)).applyInArrow(of_cell, f"sample_id {kind}, {columns}")


def shadow_reach(height: Column, lowest: Column) -> Column:
    """Metres within which something of a height can stand above a sun of at least `lowest` degrees, a metre generous."""
    cast = F.greatest(height - EYE_HEIGHT_M, F.lit(0.0)) / F.tan(F.radians(lowest)) + 1.0
    return F.least(F.coalesce(F.when(lowest > 0.0, cast), F.lit(RAY_CAP_M)), F.lit(RAY_CAP_M))


def lowest_sun(points: DataFrame) -> DataFrame:
    """One row: the lowest elevation of any point's sun."""
    return points.agg(F.min("elevation_deg").cast("double").alias("lowest_deg"))


def wall_boxes(buildings: DataFrame, lowest: DataFrame | None = None, cell_m: float = CELL_M) -> DataFrame:
    """Walls in every cell from which a ray can reach them, or, with `lowest_sun`, from which they can hide that sun."""
    rows, reach = walls(buildings), F.lit(RAY_CAP_M)
    if lowest is not None:
        rows, reach = rows.crossJoin(F.broadcast(lowest)), shadow_reach(F.col("height_m"), F.col("lowest_deg"))
    return box_cells(
        rows, F.least("ax", "bx") - reach, F.least("ay", "by") - reach,
        F.greatest("ax", "bx") + reach, F.greatest("ay", "by") + reach, cell_m).drop("lowest_deg")


def wall_pairs(samples: DataFrame, buildings: DataFrame, how: str = "inner", facing_only: bool = True, lowest: DataFrame | None = None) -> DataFrame:
    """Samples with every wall within reach of a ray; facing_only=False keeps both sorts, told apart by `faces`.

    With `lowest_sun` walls that are too far to hide that sun may be left out.
    """
    reach = RAY_CAP_M
    wall = wall_boxes(buildings, lowest)
    points = point_cells(samples, "x_m", "y_m", CELL_M)
    faces = ((F.col("bx") - F.col("ax")) * (F.col("y_m") - F.col("ay"))
             - (F.col("by") - F.col("ay")) * (F.col("x_m") - F.col("ax"))) < 0.0
    # distance to the wall's midpoint bounds the distance to the wall
    mx, my = (F.col("ax") + F.col("bx")) / 2.0 - F.col("x_m"), (F.col("ay") + F.col("by")) / 2.0 - F.col("y_m")
    half = F.sqrt(F.pow(F.col("bx") - F.col("ax"), F.lit(2.0))
                  + F.pow(F.col("by") - F.col("ay"), F.lit(2.0))) / 2.0
    near = F.sqrt(mx * mx + my * my) <= half + reach
    if facing_only:
        return cell_join(points, wall, "sample_id", faces & near, how)
    return cell_join(points, wall, "sample_id", near, how).withColumn("faces", faces)


def ray_hit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(metres to the wall along direction d, whether the ray crosses it)."""
    rx, ry = F.col("ax") - F.col("x_m"), F.col("ay") - F.col("y_m")
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    along = (rx * ey - ry * ex) / den
    share = (rx * dy - ry * dx) / den
    crosses = den.isNotNull() & (along >= 0.0) & (along <= RAY_CAP_M) & share.between(-EDGE_SLACK, 1.0 + EDGE_SLACK)
    return along, crosses


def obstruction_ratio(along: Column, height: Column) -> Column:
    """Tangent of the roof line's elevation; touching a wall blocks the ray fully."""
    return F.when(along <= TOUCH_M, F.lit(BLOCKED_RATIO)).otherwise((height - EYE_HEIGHT_M) / along)


def building_horizon(samples: DataFrame, buildings: DataFrame) -> DataFrame:
    """(sample_id, opaque) for every sample.

    One shuffle per side. Only walls that face the sample can be hit first, and
    each is tested just on the bins between the bearings of its two ends.
    """
    standing = materialize(samples_inside(samples, buildings), "inside").withColumn("inside", F.lit(True))
    points = (samples.select("sample_id", "x_m", "y_m")
              .join(standing, "sample_id", "left")
              .withColumn("inside", F.coalesce("inside", F.lit(False))))
    boxes = wall_boxes(buildings, cell_m=HORIZON_CELL_M).drop("building_id")
    return _by_cell(point_cells(points, "x_m", "y_m", HORIZON_CELL_M), boxes, _opaque_of_cell, "opaque array<smallint>")


def crown_boxes(trees: DataFrame, lowest: DataFrame | None = None, cell_m: float = CELL_M) -> DataFrame:
    """Crowns in every cell from which a ray can reach them, or, with `lowest_sun`, from which they can dim that sun."""
    crowns = trees.select(
        "tree_id", F.col("x_m").alias("tx"), F.col("y_m").alias("ty"),
        *[F.col(c).cast("double").alias(c) for c in ("crown_radius_m", "crown_base_m", "crown_top_m", "tau")],
        *[c for c in ("species",) if c in trees.columns])
    reach = F.col("crown_radius_m") + RAY_CAP_M
    if lowest is not None:
        crowns, reach = crowns.crossJoin(F.broadcast(lowest)), F.col("crown_radius_m") + shadow_reach(F.col("crown_top_m"), F.col("lowest_deg"))
    return box_cells(crowns, F.col("tx") - reach, F.col("ty") - reach, F.col("tx") + reach, F.col("ty") + reach, cell_m).drop("lowest_deg")


def crown_pairs(samples: DataFrame, trees: DataFrame, how: str = "inner", lowest: DataFrame | None = None) -> DataFrame:
    """Samples with every crown that a ray of theirs can reach; with `lowest_sun` crowns too far to dim that sun may be left out."""
    points = point_cells(samples, "x_m", "y_m", CELL_M)
    dx, dy = F.col("tx") - F.col("x_m"), F.col("ty") - F.col("y_m")
    return cell_join(points, crown_boxes(trees, lowest), "sample_id", F.sqrt(dx * dx + dy * dy) <= F.col("crown_radius_m") + RAY_CAP_M, how)


def crown_ray(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(metres to the trunk's foot along direction d, whether the ray meets the crown in plan)."""
    tx, ty = F.col("tx") - F.col("x_m"), F.col("ty") - F.col("y_m")
    along = tx * dx + ty * dy
    lateral = F.abs(tx * dy - ty * dx)
    return along, (lateral <= F.col("crown_radius_m")) & (along > 0.0) & (along <= RAY_CAP_M)


def in_crown_band(along: Column, tangent) -> Column:
    """Whether the beam is between crown base and top above the trunk's foot."""
    height = along * tangent + EYE_HEIGHT_M
    return (F.col("crown_base_m") <= height) & (height <= F.col("crown_top_m"))


def canopy_horizon(samples: DataFrame, trees: DataFrame) -> DataFrame:
    """(sample_id, canopy, tau_q) for every sample; same shuffles as building_horizon."""
    points = point_cells(samples.select("sample_id", "x_m", "y_m"), "x_m", "y_m", HORIZON_CELL_M)
    return _by_cell(points, crown_boxes(trees, cell_m=HORIZON_CELL_M).drop("tree_id", "species"), _canopy_of_cell, "canopy array<smallint>, tau_q array<smallint>")


def horizons(samples: DataFrame, buildings: DataFrame, trees: DataFrame) -> DataFrame:
    """The horizon table: one row per sample with all three arrays."""
    # footprints, walls and crowns read them twice each, once for hot cells
    samples = materialize(samples.select("sample_id", "x_m", "y_m"), "samples")
    opaque = building_horizon(samples, buildings)
    canopy = canopy_horizon(samples, trees)
    return opaque.join(canopy, "sample_id").select("sample_id", "opaque", "canopy", "tau_q")
