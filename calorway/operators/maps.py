"""Tables behind a map view: footprints in boxes and tiles, shadows, exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.projection import to_degrees
from ..schemas import PATH
from ..session import materialize
from .cells import box_levels, cell_join, cell_of, cover_cells, levels_of

TILE_LON_DEG, TILE_LAT_DEG, TILE_LEVELS = 0.0075, 0.005, 4
TILE_LIMIT = 450
# fixed values: shadow drawing limits
MIN_SHADOW_ELEVATION_DEG, MAX_REACH_M, MIN_SHADOW_HEIGHT_M, MIN_REACH_M = 3.0, 900.0, 8.0, 2.0
#: points of outlines whose hulls are made in one go
POINTS_AT_ONCE = 1 << 18


def validate_bbox(requests: DataFrame, text: str = "bbox") -> DataFrame:
    """Adds west, south, east, north and reject (null when valid) to rows of 'w,s,e,n' text."""
    parts = F.split(F.col(text), ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    rows = requests.withColumn("_n", numbers)
    odd = (F.size("_n") != 4) | F.exists("_n", lambda v: v.isNull())
    infinite = F.exists("_n", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    get = [F.get(F.col("_n"), F.lit(i)) for i in range(4)]
    reject = (F.when(odd, "bbox must be four comma-separated numbers: west,south,east,north")
              .when(infinite, "bbox values must be finite")
              .when((get[0] > get[2]) | (get[1] > get[3]), "bbox must be ordered west,south,east,north"))
    return rows.withColumns({**dict(zip(("west", "south", "east", "north"), get)), "reject": reject}).drop("_n")


def _cutter(label: Column, n: int):
    return lambda i: F.substring(label, i, F.lit(n))


def place_filter(places: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Per query, the first places (by place_id) whose label holds every word, ignoring case.

    A label is indexed by its runs of one, two and three letters. A query looks up the
    first letters of its longest word, all words are then checked. A query without words
    takes the first places of all.
    """
    words = F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "")
    asked = queries.select("query_id", words.alias("_w"))
    longest = F.element_at(F.array_sort(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = asked.filter(F.size("_w") > 0).withColumn("_gram", F.substring(longest, 1, 3))
    label = F.lower("label")
    grams = F.array_distinct(F.flatten(F.array(*[F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(label) - n + 1, F.lit(1))), _cutter(label, n)) for n in (1, 2, 3)])))
    indexed = places.withColumn("_key", F.explode(grams))
    hits = indexed.join(keyed, (F.col("_key") == F.col("_gram")) & F.forall("_w", lambda w: F.contains(label, w))).drop("_key", "_gram")
    anything = places.orderBy("place_id").limit(limit).crossJoin(asked.filter(F.size("_w") == 0))
    hits = hits.unionByName(anything)
    order = W.partitionBy("query_id").orderBy("place_id")
    return hits.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= limit).drop("_i", "_w")


def buildings_in_view(footprints: DataFrame, boxes: DataFrame, cell_m: float = 500.0) -> DataFrame:
    """(box_id, building_id, height_m) whose bounds meet a box.

    footprints: building_id, height_m, bx0..by1; boxes: box_id, x0..y1. A view is covered
    at the level of its own size, so a view of the whole world makes four rows. Both sides
    may meet several cells, so a pair counts only in the cell of its lower corner.
    """
    right = cover_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell_m)
    left = footprints.select("building_id", "height_m", "bx0", "by0", "bx1", "by1")
    left = box_levels(left, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), cell_m, levels_of(right)).drop("level")
    corner_x, corner_y = cell_of(F.greatest("bx0", "x0"), F.greatest("by0", "y0"), cell_m, F.col("level"))
    meets = ((F.col("bx0") <= F.col("x1")) & (F.col("bx1") >= F.col("x0")) & (F.col("by0") <= F.col("y1")) & (F.col("by1") >= F.col("y0"))
             & (F.col("cell_x") == corner_x) & (F.col("cell_y") == corner_y))
    return cell_join(left, right, "building_id", meets).select("box_id", "building_id", "height_m")


def tallest_in_view(hits: DataFrame, k: int, omit_truncated: bool = False) -> DataFrame:
    """Per box the k tallest footprints (ties by id) and whether more were there."""
    more = hits.groupBy("box_id").agg((F.count(F.lit(1)) > k).alias("truncated"))
    order = W.partitionBy("box_id").orderBy(F.desc("height_m"), "building_id")
    top = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).join(more, "box_id")
    return top.filter(~F.col("truncated")) if omit_truncated else top


def view_complete_or_none(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """All footprints of all boxes; truncated marks boxes with more than `limit`, for callers that then draw none."""
    if limit is None:
        return hits.select("box_id", "building_id", "height_m", F.lit(False).alias("truncated"))
    sizes = hits.groupBy("box_id").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return hits.join(sizes, "box_id").select("box_id", "building_id", "height_m", "truncated")


def building_tiles(footprints: DataFrame, limit: int = TILE_LIMIT, levels: int = TILE_LEVELS) -> DataFrame:
    """(level, tile_x, tile_y, building_id, truncated): globally aligned tiles, dense ones split in four.

    footprints: building_id and lon/lat bounds w, s, e, n. At the last level a
    dense tile keeps all its footprints and is flagged.
    """
    pending, done = footprints.select("building_id", "w", "s", "e", "n"), None
    parents = None
    for level in range(levels + 1):
        lon, lat = TILE_LON_DEG / 2 ** level, TILE_LAT_DEG / 2 ** level
        tiles = pending.select("*", F.explode(F.sequence(F.floor(F.col("w") / lon).cast("long"), F.floor(F.col("e") / lon).cast("long"))).alias("tile_x"))
        tiles = tiles.select("*", F.explode(F.sequence(F.floor(F.col("s") / lat).cast("long"), F.floor(F.col("n") / lat).cast("long"))).alias("tile_y"))
        if parents is not None:
            up = parents.select(F.col("tile_x").alias("_px"), F.col("tile_y").alias("_py"))
            tiles = tiles.join(up, (F.floor(F.col("tile_x") / 2) == F.col("_px")) & (F.floor(F.col("tile_y") / 2) == F.col("_py"))).drop("_px", "_py")
        tiles = materialize(tiles, "tiles")
        dense = tiles.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")
        flagged = tiles.join(dense.withColumn("truncated", F.lit(True)), ["tile_x", "tile_y"], "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
        ready = flagged if level == levels else flagged.filter(~F.col("truncated"))
        ready = ready.select(F.lit(level).alias("level"), "tile_x", "tile_y", "building_id", "truncated")
        done = ready if done is None else done.unionByName(ready)
        if level == levels:
            break
        parents = materialize(dense, "dense")
        if parents.limit(1).count() == 0:
            break
        pending = flagged.filter("truncated").select("building_id", "w", "s", "e", "n").dropDuplicates(["building_id"])
    return done


def dedupe_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.select("building_id").dropDuplicates(["building_id"])


def _ring_degrees(ring: Column) -> Column:
    def one(p):
        lon, lat = to_degrees(p["x"], p["y"])
        return F.named_struct(F.lit("x"), lon, F.lit("y"), lat)
    return F.transform(ring, one)


def geographic_footprints(buildings: DataFrame) -> DataFrame:
    """Adds `outline` (outer ring in degrees) and its bounds w, s, e, n."""
    from ..functions.geometry import bounds
    rows = buildings.withColumn("outline", _ring_degrees(F.col("rings")[0]))
    w, s, e, n = bounds(F.col("outline"))
    return rows.withColumns({"w": w, "s": s, "e": e, "n": n})


def footprint_export(buildings: DataFrame) -> DataFrame:
    """(building_id, height_m, base_m, n_points, lon_lat) with micro-degree integers; ringless rows drop out."""
    rows = geographic_footprints(buildings.filter((F.size("rings") > 0) & (F.size(F.col("rings")[0]) > 0)))
    pairs = F.transform("outline", lambda p: F.array(F.rint(p["x"] * 1e6).cast("int"), F.rint(p["y"] * 1e6).cast("int")))
    return rows.select("building_id", F.col("height_m").cast("float").alias("height_m"), F.col("base_m").cast("float").alias("base_m"),
                       F.size("outline").alias("n_points"), F.flatten(pairs).alias("lon_lat"))


def _chain(x: np.ndarray, y: np.ndarray, count: np.ndarray, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many) of half a hull for all rows at once: the sorted points of a row are taken in order, or backwards."""
    rows, width = x.shape
    stack, top, every = np.zeros((rows, width), np.int64), np.zeros(rows, np.int64), np.arange(rows)
    for k in range(width):
        at = every[k < count]
        new = count[at] - 1 - k if turned else np.full(len(at), k)
        open_rows = np.flatnonzero(top[at] > 1)
        while len(open_rows):
            r, p = at[open_rows], new[open_rows]
            one, two = stack[r, top[r] - 1], stack[r, top[r] - 2]
            cross = (x[r, one] - x[r, two]) * (y[r, p] - y[r, two]) - (y[r, one] - y[r, two]) * (x[r, p] - x[r, two])
            open_rows, r = open_rows[cross <= 0], r[cross <= 0]
            top[r] -= 1
            open_rows = open_rows[top[r] > 1]
        stack[at, top[at]] = new
        top[at] += 1
    return stack, top


def _hulls(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """Hulls of rows of sorted, distinct points, padded to one width."""
    sides = [_chain(x, y, count, turned) for turned in (False, True)]
    width, few = np.arange(x.shape[1]), (count <= 2)[:, None]
    # a half ends where the other begins; one or two points stand as they are
    kept = [np.where(few, (width < count[:, None]) & (not turned), width < top[:, None] - 1) for turned, (_, top) in enumerate(sides)]
    places = np.concatenate([np.where(few, width, sides[0][0]), sides[1][0]], axis=1)
    kept = np.concatenate(kept, axis=1)
    row, _ = np.nonzero(kept)
    points = pa.StructArray.from_arrays([pa.array(c[row, places[kept]]) for c in (x, y)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype("int32")), points)


@F.arrow_udf(PATH)
def convex_hull(outlines: pa.Array) -> pa.Array:
    """Counter-clockwise hull of each small point set, by monotone chains over all sets of a batch in step.

    Points without both coordinates are left out; without an outline there is no hull.
    """
    flat = outlines.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype("float64") for c in ("x", "y"))
    row = np.repeat(np.arange(len(outlines)), pc.fill_null(pc.list_value_length(outlines), 0).to_numpy(zero_copy_only=False))
    known = ~(np.isnan(x) | np.isnan(y))
    x, y, row = x[known], y[known], row[known]
    order = np.lexsort((y, x, row))
    x, y, row = x[order], y[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, row = x[new], y[new], row[new]
    count = np.bincount(row, minlength=len(outlines))
    first = np.cumsum(count) - count
    # sets of like size go together, so that one long outline does not widen all
    size = np.ceil(np.log2(np.maximum(count, 1))).astype("int64")
    done, members = [], []
    for s in np.unique(size):
        alike = np.flatnonzero(size == s)
        step = max(1, POINTS_AT_ONCE >> int(s))
        for part in (alike[i:i + step] for i in range(0, len(alike), step)):
            width = np.arange(count[part].max())
            at = np.minimum(first[part, None] + np.minimum(width, np.maximum(count[part, None] - 1, 0)), max(len(x) - 1, 0))
            px, py = (c[at] if len(c) else np.zeros(at.shape) for c in (x, y))
            done.append(_hulls(px, py, count[part]))
            members.append(part)
    if not done:
        return pa.array([], outlines.type)
    place = np.argsort(np.concatenate(members))
    found = pa.concat_arrays(done).take(pa.array(place))
    return pc.if_else(outlines.is_valid(), found, pa.scalar(None, found.type)) if outlines.null_count else found


def shadow_polygons(footprints: DataFrame, suns: DataFrame, centre_lat: float) -> DataFrame:
    """(epoch_s, building_id, height_m, reach_m, shadow) for every building and sun instant.

    A shadow is the hull of the footprint and its copy moved away from the sun.
    Every building has a shadow at every instant, so the product is the result
    itself; few instants are broadcast. Low suns, low buildings and tiny reaches
    cast none.
    """
    import math
    rad = math.radians(centre_lat)
    per_lat = 111132.92 - 559.82 * math.cos(2 * rad)
    per_lon = 111412.84 * math.cos(rad) - 93.5 * math.cos(3 * rad)
    high = suns.filter(F.col("elevation_deg") >= MIN_SHADOW_ELEVATION_DEG).select("epoch_s", "azimuth_deg", "elevation_deg")
    tall = footprints.filter(F.col("height_m") >= MIN_SHADOW_HEIGHT_M).select("building_id", "height_m", "outline")
    rows = tall.crossJoin(F.broadcast(high) if high.count() <= 10_000 else high)
    rows = rows.withColumn("reach_m", F.least(F.col("height_m") / F.tan(F.radians("elevation_deg")), F.lit(MAX_REACH_M)))
    rows = rows.filter(F.col("reach_m") >= MIN_REACH_M)
    away = F.radians(F.col("azimuth_deg") + 180.0)
    rows = rows.withColumns({"_dx": F.col("reach_m") * F.sin(away) / per_lon, "_dy": F.col("reach_m") * F.cos(away) / per_lat})
    moved = F.transform("outline", lambda p: F.named_struct(F.lit("x"), p["x"] + F.col("_dx"), F.lit("y"), p["y"] + F.col("_dy")))
    rows = rows.withColumn("shadow", convex_hull(F.concat("outline", moved)))
    return rows.filter(F.size("shadow") >= 3).select("epoch_s", "building_id", "height_m", "reach_m", "shadow")
