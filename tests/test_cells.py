import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorway.functions import geometry as G
from calorway.operators import graph as GR
from calorway.operators import landcover as L
from calorway.operators.cells import cover_cells
from calorway.operators.components import components, linked_roots
from calorway.operators.maps import buildings_in_view
from calorway.operators.numbering import order_statistics
from calorway.operators.waypoints import amenities_in_view


def test_views_of_any_width(spark):
    rng = random.Random(1)
    places = [(k, 0, f"a{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)] + [(900 + k, 1, "near", 40.75 + k / 1000, -73.98) for k in range(50)]
    boxes = [(1, -180.0, -90.0, 180.0, 90.0), (2, -73.981, 40.7499, -73.979, 40.7601), (3, -10.0, 0.0, 30.0, 45.0), (4, -73.98, 40.75, -73.98, 40.75), (5, 170.0, 80.0, 180.0, 90.0)]
    a = spark.createDataFrame(places, "amenity_id long, kind int, name string, lat double, lon double")
    b = spark.createDataFrame(boxes, "box_id long, west double, south double, east double, north double")
    got = sorted((r["box_id"], r["amenity_id"]) for r in amenities_in_view(a, b).collect())
    want = sorted((i, p[0]) for i, w, s, e, n in boxes for p in places if w <= p[4] <= e and s <= p[3] <= n)
    assert got == want and len(want) > 350
    covered = cover_cells(b, F.col("west"), F.col("south"), F.col("east"), F.col("north"), 0.01)
    assert max(r["count"] for r in covered.groupBy("box_id").count().collect()) <= 4
    assert amenities_in_view(a, b.limit(0)).count() == 0


def test_footprints_in_views_of_any_width(spark):
    rng = random.Random(2)
    prints = [(k, 10.0 + k, x, y, x + rng.uniform(5, 900), y + rng.uniform(5, 60)) for k in range(400) for x, y in [(rng.uniform(0, 60000), rng.uniform(0, 60000))]]
    boxes = [(1, -1e7, -1e7, 1e7, 1e7), (2, 100.0, 100.0, 9000.0, 30000.0), (3, 30000.0, 30000.0, 30400.0, 30300.0), (4, 0.0, 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(prints, "building_id long, height_m double, bx0 double, by0 double, bx1 double, by1 double")
    b = spark.createDataFrame(boxes, "box_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["box_id"], r["building_id"]) for r in buildings_in_view(f, b).collect())
    want = sorted((i, p[0]) for i, x0, y0, x1, y1 in boxes for p in prints if p[2] <= x1 and p[4] >= x0 and p[3] <= y1 and p[5] >= y0)
    assert got == want and len(got) == len(set(got)) > 400


@pytest.mark.parametrize("values", [[], [4.0], [1.0, 2.0], [5.0, 1.0, None, 1.0, 9.5, 2.25, 2.25, 700.0], [float(k * 37 % 101) for k in range(999)]])
def test_order_statistics_equal_numpy(spark, values):
    row = order_statistics(spark.createDataFrame([(v,) for v in values], "h double"), "h", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}).first()
    known = [v for v in values if v is not None]
    assert row["n"] == len(known)
    for name, q in (("p0", 0), ("p50", 50), ("p99", 99), ("top", 100)):
        assert row[name] == (pytest.approx(float(np.percentile(known, q))) if known else None)


@pytest.mark.parametrize("resolution,out", [(10.0, 20.0), (3.0, 1.0), (0.5, 1.0), (7.0, 2.5)])
def test_canopy_mask_takes_the_pixel_of_each_centre(spark, resolution, out):
    rng = random.Random(3)
    x0, y1, n = 100.0, 400.0, int(60 / resolution) + 2
    classes = {(r, c): rng.randrange(1, 4) for r in range(n) for c in range(n) if rng.random() < 0.8}
    pixels = spark.createDataFrame([(r, c, k) for (r, c), k in classes.items()], "row long, col long, class int")
    mx0, my0, mx1, my1 = 105.0, 350.0, 148.0, 395.0
    scope = spark.createDataFrame([(mx0, my0, mx1, my1)], "mx0 double, my0 double, mx1 double, my1 double")
    got = sorted((r["row"], r["col"]) for r in L.canopy_mask(scope, pixels, x0, y1, resolution, out).collect())
    rows, cols = max(1, int((my1 - my0) // out)), max(1, int((mx1 - mx0) // out))
    want = sorted((r, c) for r in range(rows) for c in range(cols) if classes.get(
        (math.floor((y1 - (my1 - (r + 0.5) * out)) / resolution), math.floor((mx0 + (c + 0.5) * out - x0) / resolution))) == 1)
    assert got == want and len(got) >= rows * cols // 10


def corner(radius, legs=40.0, steps=8):
    """East, round a left-hand bend, then north."""
    arc = [(legs + radius * math.sin(a), radius - radius * math.cos(a)) for a in (math.pi / 2 * k / steps for k in range(1, steps))]
    return [(0.0, 0.0), (legs, 0.0), *arc, (legs + radius, radius), (legs + radius, radius + legs)]


def offsets(spark, paths, by):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, path array<struct<x:double,y:double>>")
    df = df.withColumn("segs", G.normals(F.col("path")))
    return [None if r["o"] is None else [(p["x"], p["y"]) for p in r["o"]] for r in df.select("k", G.trimmed_offset(F.col("segs"), F.lit(by)).alias("o")).orderBy("k").collect()]


def test_bends_tighter_than_the_offset_keep_their_inner_sidewalk(spark):
    by = 40 * 0.3048 / 2 + 2
    for radius, got in zip((5.0, 6.0, 7.0), offsets(spark, [corner(r) for r in (5.0, 6.0, 7.0)], by)):
        # nothing of the arc is left: the two legs meet
        assert [tuple(round(v, 6) for v in p) for p in got] == [(0.0, round(by, 6)), (round(40 + radius - by, 6), round(by, 6)), (round(40 + radius - by, 6), round(radius + 40, 6))]
    wide = offsets(spark, [corner(20.0)], by)[0]
    assert len(wide) == 11 and all(math.dist(p, (40.0, 20.0)) == pytest.approx(20.0 - by, abs=0.15) for p in wide[2:-2])
    outer = offsets(spark, [corner(6.0)], -by)[0]
    assert len(outer) == 11 and all(math.dist(p, (40.0, 6.0)) == pytest.approx(6.0 + by, abs=0.15) for p in outer[2:-2])


def test_offsets_that_vanish_straight_lines_and_spikes(spark):
    ring = [(10 * math.cos(a), 10 * math.sin(a)) for a in (2 * math.pi * k / 12 for k in range(12))]
    straight = [(0.0, 0.0), (10.0, 0.0), (30.0, 0.0)]
    spike = [(0.0, 0.0), (20.0, 0.0), (20.5, 4.0), (21.0, 0.0), (40.0, 0.0)]
    got = offsets(spark, [straight, spike], -6.0)
    assert got[0] == [(0.0, -6.0), (10.0, -6.0), (30.0, -6.0)]
    assert got[1][0] == (0.0, -6.0) and got[1][-1] == (40.0, -6.0) and all(p[1] <= -5.9 for p in got[1])
    assert offsets(spark, [ring], 12.0)[0] is None or len(offsets(spark, [ring], 12.0)[0]) >= 2


def test_streets_keep_their_pair_of_sidewalks(spark):
    rows = [(k, k, "Bend", "1", 40 * 0.3048, corner(r)) for k, r in enumerate((6.0, 7.0))]
    streets = spark.createDataFrame(rows, "seq long, physical_id long, street_name string, borough string, street_width_m double, path array<struct<x:double,y:double>>")
    sides = GR.sidewalk_paths(streets).orderBy("seq", "side").collect()
    assert len(sides) == 4 and not any(r["offset_fallback"] for r in sides)
    assert all((r["length_m"] < 90) == (r["side"] == 0) for r in sides)


def test_components_of_hubs_chains_and_loops(spark):
    hub = [(50_000, k) for k in range(1, 3000)]
    chain = [(100_000 + k, 100_001 + k) for k in range(300)]
    links = hub + chain + [(200_001, 200_002), (200_002, 200_001), (7, 7), (300_000, 300_000)]
    roots = {r["node"]: r["root"] for r in linked_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[k] == 1 for k in range(1, 3000)) and roots[50_000] == 1
    assert all(roots[100_000 + k] == 100_000 for k in range(301)) and roots[200_002] == 200_001 and 300_000 not in roots
    nodes = spark.createDataFrame([(5,), (300_000,), (400_000,)], "node_id long")
    got = {r["node_id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), nodes).collect()}
    assert got == {5: 1, 300_000: 300_000, 400_000: 400_000}
    assert linked_roots(spark.createDataFrame([], "a long, b long")).count() == 0
