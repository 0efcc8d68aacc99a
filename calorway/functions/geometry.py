"""Plan geometry on array<struct<x,y>> columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PATH
from .numeric import as_col, floor_mod

# fixed values: longest mitre, in offsets, before a corner is bevelled
MITRE_LIMIT = 5.0


def point(x, y) -> Column:
    return F.named_struct(F.lit("x"), as_col(x).cast("double"), F.lit("y"), as_col(y).cast("double"))


def path_of(*xy) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def distance(ax, ay, bx, by) -> Column:
    dx, dy = as_col(bx) - as_col(ax), as_col(by) - as_col(ay)
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(ax, ay, bx, by) -> Column:
    """Compass degrees from a to b: 0 north, 90 east."""
    return floor_mod(F.degrees(F.atan2(as_col(bx) - as_col(ax), as_col(by) - as_col(ay))) + 360.0, 360.0)


def path_bearing(path: Column) -> Column:
    a, b = path[0], F.element_at(path, -1)
    return bearing_deg(a["x"], a["y"], b["x"], b["y"])


def segments(path: Column) -> Column:
    """array<struct<a,b>> of consecutive point pairs."""
    n = F.size(path)
    return F.zip_with(
        F.slice(path, F.lit(1), n - 1), F.slice(path, F.lit(2), n - 1),
        lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b))


def _length(seg: Column) -> Column:
    return distance(seg["a"]["x"], seg["a"]["y"], seg["b"]["x"], seg["b"]["y"])


def path_length(path: Column) -> Column:
    return F.aggregate(segments(path), F.lit(0.0), lambda acc, s: acc + _length(s))


def _state(left, at) -> Column:
    return F.named_struct(F.lit("left"), left, F.lit("at"), at)


def _walked(state, seg) -> Column:
    """(metres left, place) after a segment."""
    length, left = _length(seg), state["left"]
    share = F.when(length > 0.0, F.least(left / length, F.lit(1.0))).otherwise(F.lit(0.0))
    moved = point(
        seg["a"]["x"] + (seg["b"]["x"] - seg["a"]["x"]) * share,
        seg["a"]["y"] + (seg["b"]["y"] - seg["a"]["y"]) * share)
    return F.when(left > 0.0, _state(left - length, moved)).otherwise(state)


def interpolate(path: Column, metres: Column) -> Column:
    """Point at a distance along the path, clamped to its ends."""
    return F.aggregate(segments(path), _state(metres.cast("double"), path[0]), _walked)["at"]


def interpolate_many(path: Column, metres: Column) -> Column:
    """The same for rows that ask for many places of a plain path column: a path of one segment needs no walk."""
    line = F.named_struct(F.lit("a"), path[0], F.lit("b"), F.get(path, F.lit(1)))
    straight = _walked(_state(metres.cast("double"), path[0]), line)["at"]
    return F.when(F.size(path) == 2, straight).otherwise(interpolate(path, metres))


def drop_repeats(path: Column) -> Column:
    """Removes consecutive equal points."""
    return F.aggregate(
        path, F.array().cast(PATH),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == p), acc)
        .otherwise(F.concat(acc, F.array(p))))


def normals(path: Column) -> Column:
    """Segments with the unit normal to the left of travel; the path must not repeat points."""
    def one(s):
        length = _length(s)
        return F.named_struct(F.lit("a"), s["a"], F.lit("b"), s["b"],
                              F.lit("nx"), (s["a"]["y"] - s["b"]["y"]) / length,
                              F.lit("ny"), (s["b"]["x"] - s["a"]["x"]) / length)
    return F.transform(segments(path), one)


def offset_path(segs: Column, offset_m: Column) -> Column:
    """Parallel of the path whose normals() are given; positive offsets lie left of travel.

    Corners are mitred, and bevelled where the mitre passes MITRE_LIMIT. The
    direction of travel is kept.
    """
    n = F.size(segs)

    def moved(p, nx, ny):
        return point(p["x"] + nx * offset_m, p["y"] + ny * offset_m)

    def corner(s, t):
        dot = s["nx"] * t["nx"] + s["ny"] * t["ny"]
        # squared mitre ratio is 2 / (1 + dot)
        sharp = (dot + 1.0) * (MITRE_LIMIT * MITRE_LIMIT) < 2.0
        mitre = moved(s["b"], (s["nx"] + t["nx"]) / (dot + 1.0), (s["ny"] + t["ny"]) / (dot + 1.0))
        return F.when(sharp, F.array(moved(s["b"], s["nx"], s["ny"]), moved(s["b"], t["nx"], t["ny"]))
                      ).otherwise(F.array(mitre))

    first, last = segs[0], F.element_at(segs, -1)
    middle = F.flatten(F.zip_with(F.slice(segs, F.lit(1), n - 1), F.slice(segs, F.lit(2), n - 1), corner))
    return F.concat(
        F.array(moved(first["a"], first["nx"], first["ny"])), middle,
        F.array(moved(last["b"], last["nx"], last["ny"])))


def offset_is_sound(path: Column, offset: Column) -> Column:
    """False where an offset folds over itself: bevelled, or a segment turned back."""
    same = F.size(path) == F.size(offset)
    along = F.forall(
        F.zip_with(segments(path), segments(offset), lambda s, o:
                   (s["b"]["x"] - s["a"]["x"]) * (o["b"]["x"] - o["a"]["x"])
                   + (s["b"]["y"] - s["a"]["y"]) * (o["b"]["y"] - o["a"]["y"]) > 0.0),
        lambda ok: ok)
    return same & F.coalesce(along, F.lit(False))


def trimmed_offset(segs: Column, offset_m: Column) -> Column:
    """Parallel of the path whose normals() are given, without the segments that a bend has swallowed.

    Every segment moves aside on its own line, and neighbours meet where their lines cross. A
    segment that then runs backwards is dropped and its neighbours meet each other instead, until
    none runs backwards. Lines that do not cross, and outer corners past MITRE_LIMIT, keep both
    moved ends. Null when no segment is left.
    """
    def moved(s):
        dx, dy = s["nx"] * offset_m, s["ny"] * offset_m
        return F.named_struct(F.lit("a"), point(s["a"]["x"] + dx, s["a"]["y"] + dy), F.lit("b"), point(s["b"]["x"] + dx, s["b"]["y"] + dy),
                              F.lit("ux"), s["ny"], F.lit("uy"), -s["nx"])

    def joint(s, t):
        """Where the lines of two neighbours cross; null when they keep their own ends."""
        cross, dot = s["ux"] * t["uy"] - s["uy"] * t["ux"], s["ux"] * t["ux"] + s["uy"] * t["uy"]
        along = ((t["a"]["x"] - s["a"]["x"]) * t["uy"] - (t["a"]["y"] - s["a"]["y"]) * t["ux"]) / F.when(F.abs(cross) > 1e-9, cross)
        outward = along > (s["b"]["x"] - s["a"]["x"]) * s["ux"] + (s["b"]["y"] - s["a"]["y"]) * s["uy"]
        sharp = outward & ((dot + 1.0) * (MITRE_LIMIT * MITRE_LIMIT) < 2.0)
        return F.when(along.isNotNull() & ~sharp, point(s["a"]["x"] + s["ux"] * along, s["a"]["y"] + s["uy"] * along))

    def ends(lines):
        """Every line with its start and end after meeting its neighbours."""
        def one(s, i):
            before, after = F.get(lines, i - 1), F.get(lines, i + 1)
            return F.named_struct(F.lit("s"), s, F.lit("p"), F.coalesce(F.when(before.isNotNull(), joint(before, s)), s["a"]),
                                  F.lit("q"), F.coalesce(F.when(after.isNotNull(), joint(s, after)), s["b"]))
        return F.transform(lines, one)

    def forward(e):
        return (e["q"]["x"] - e["p"]["x"]) * e["s"]["ux"] + (e["q"]["y"] - e["p"]["y"]) * e["s"]["uy"] > 1e-9

    # a round drops one segment at least, or the path has come to rest
    rounds = F.sequence(F.lit(1), F.size(segs))
    kept = F.aggregate(rounds, F.transform(segs, moved), lambda lines, _: F.transform(F.filter(ends(lines), forward), lambda e: e["s"]))
    # one element, so that the rest is computed once however often it is read
    return F.transform(F.array(kept), lambda lines: F.when(
        F.size(lines) > 0, drop_repeats(F.flatten(F.transform(ends(lines), lambda e: F.array(e["p"], e["q"]))))))[0]


def ring_area(ring: Column) -> Column:
    """Signed area, positive when counter-clockwise."""
    return F.aggregate(
        segments(ring), F.lit(0.0), lambda acc, s: acc
        + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2.0)


def ring_is_simple(ring: Column) -> Column:
    """Whether no two sides of a closed ring cross."""
    sides = segments(ring)
    count = F.size(ring) - 1

    def turn(a, b, p):
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def crosses(s, t):
        return ((turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0.0)
                & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0.0))

    # neighbours share an end, so they can't cross inside both
    rows = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.exists(
        F.slice(sides, i + 2, F.greatest(count - i - 1, F.lit(0))), lambda t: crosses(F.get(sides, i), t)))
    return ~F.exists(rows, lambda bad: bad)


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring, taken about its first point."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    def sums_of(a, x, y):
        return F.named_struct(F.lit("a"), a, F.lit("x"), x, F.lit("y"), y)

    zero = sums_of(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def add(acc, s):
        ax, ay = s["a"]["x"] - ox, s["a"]["y"] - oy
        bx, by = s["b"]["x"] - ox, s["b"]["y"] - oy
        cross = ax * by - bx * ay
        return sums_of(acc["a"] + cross, acc["x"] + (ax + bx) * cross, acc["y"] + (ay + by) * cross)

    sums = F.aggregate(segments(ring), zero, add)
    return point(ox + sums["x"] / (sums["a"] * 3.0), oy + sums["y"] / (sums["a"] * 3.0))


def bounds(path: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay = as_col(px), as_col(py), as_col(ax), as_col(ay)
    ex, ey = as_col(bx) - ax, as_col(by) - ay
    norm = ex * ex + ey * ey
    share = F.coalesce(F.try_divide((px - ax) * ex + (py - ay) * ey, norm), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, ax + ex * share, ay + ey * share)


# ---- well-known binary: a codec per row, batched through Arrow -------------

_HEADER = np.dtype([("order", "u1"), ("kind", "<u4"), ("count", "<u4")])


def _pack(kind: int, count: int) -> bytes:
    return np.array([(1, kind, count)], dtype=_HEADER).tobytes()


def _coords(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], dtype="<f8")


@F.pandas_udf(T.BinaryType())
def line_to_wkb(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else _pack(2, len(p)) + _coords(p).tobytes())


@F.pandas_udf(T.BinaryType())
def rings_to_wkb(polygons: pd.Series) -> pd.Series:
    def encode(rings):
        if rings is None:
            return None
        body = b"".join(np.uint32(len(r)).tobytes() + _coords(r).tobytes() for r in rings)
        return _pack(3, len(rings)) + body
    return polygons.map(encode)


def _read_points(blob: bytes, at: int, count: int, order: str):
    xy = np.frombuffer(blob, dtype=order + "f8", count=2 * count, offset=at).reshape(-1, 2)
    return [{"x": float(x), "y": float(y)} for x, y in xy]


@F.pandas_udf(PATH)
def wkb_to_line(blobs: pd.Series) -> pd.Series:
    def decode(blob):
        if blob is None:
            return None
        order = "<" if blob[0] == 1 else ">"
        kind, count = np.frombuffer(blob, dtype=order + "u4", count=2, offset=1)
        if kind != 2:
            raise ValueError(f"expected a LineString, found geometry type {kind}")
        return _read_points(blob, 9, int(count), order)
    return blobs.map(decode)


@F.pandas_udf(T.ArrayType(PATH))
def wkb_to_rings(blobs: pd.Series) -> pd.Series:
    def decode(blob):
        if blob is None:
            return None
        order = "<" if blob[0] == 1 else ">"
        kind, rings = np.frombuffer(blob, dtype=order + "u4", count=2, offset=1)
        if kind != 3:
            raise ValueError(f"expected a Polygon, found geometry type {kind}")
        out, at = [], 9
        for _ in range(int(rings)):
            count = int(np.frombuffer(blob, dtype=order + "u4", count=1, offset=at)[0])
            out.append(_read_points(blob, at + 4, count, order))
            at += 4 + 16 * count
        return out
    return blobs.map(decode)
