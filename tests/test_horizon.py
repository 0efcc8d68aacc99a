import math
import random

import numpy as np
from pyspark.sql import functions as F

from calorway.operators import evidence as E
from calorway.operators import horizon as H
from calorway.operators.cells import box_cells, cell_join, point_cells

BUILDINGS = "building_id long, height_m double, rings array<array<struct<x:double,y:double>>>"
SAMPLES = "sample_id long, x_m double, y_m double"
TREES = "tree_id long, x_m double, y_m double, species string, crown_radius_m double, crown_base_m double, crown_top_m double, tau double"


def ring(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def square(cx, cy, half):
    return ring([(cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half)])


def brute_horizon(x, y, buildings):
    """Every ray against every wall; inside by counting crossings."""
    out = []
    for b in range(72):
        dx, dy = round(math.sin(math.radians(5 * b)), 12), round(math.cos(math.radians(5 * b)), 12)
        best = 0.0
        for _, height, rings in buildings:
            dists, odd = [], False
            for r in rings:
                for (ax, ay), (bx, by) in zip(r, r[1:]):
                    if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                        odd = not odd
                    den = dx * (by - ay) - dy * (bx - ax)
                    if den:
                        s = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / den
                        u = ((ax - x) * dy - (ay - y) * dx) / den
                        if 0 <= s <= 400 and -1e-9 <= u <= 1 + 1e-9:
                            dists.append(s)
            if odd:
                best = 90.0
            elif dists:
                best = max(best, 90.0 if min(dists) <= 0.01 else math.degrees(math.atan((height - 1.1) / min(dists))))
        out.append(int(np.clip(np.rint(best), 0, 90)))
    return out


def scene():
    rng = random.Random(5)
    buildings = [(i, 5.0 + rng.random() * 80, [square(rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(5, 40))]) for i in range(40)]
    # a courtyard block, drawn clockwise with a hole
    buildings.append((99, 30.0, [square(0, 0, 60)[::-1], square(0, 0, 25)]))
    samples = [(i, rng.uniform(-320, 320), rng.uniform(-320, 320)) for i in range(60)] + [(100, 0.0, 0.0), (101, 40.0, 0.0), (102, 900.0, 900.0)]
    return samples, buildings


def test_building_horizon_equals_brute_force(spark):
    samples, buildings = scene()
    got = H.building_horizon(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(buildings, BUILDINGS))
    rows = {r["sample_id"]: list(r["opaque"]) for r in got.collect()}
    assert len(rows) == len(samples)
    for i, x, y in samples:
        assert rows[i] == brute_horizon(x, y, buildings), i


def test_due_north_building(spark):
    got = H.building_horizon(spark.createDataFrame([(0, 0.0, 0.0)], SAMPLES), spark.createDataFrame([(0, 30.0, [square(0, 50, 10)])], BUILDINGS))
    opaque = got.first()["opaque"]
    assert opaque[0] == round(math.degrees(math.atan(28.9 / 40))) and opaque[36] == 0


def test_canopy_equals_brute_force(spark):
    rng = random.Random(6)
    trees = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), "x", rng.uniform(1, 9), rng.uniform(2, 5), rng.uniform(6, 25), rng.choice([.1, .35, 1e-9])) for i in range(80)]
    samples = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(30)] + [(50, trees[0][1] + 0.5, trees[0][2]), (51, 2000.0, 0.0)]
    got = {r["sample_id"]: r for r in H.canopy_horizon(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(trees, TREES)).collect()}
    for i, x, y in samples:
        for b in range(72):
            dx, dy = round(math.sin(math.radians(5 * b)), 12), round(math.cos(math.radians(5 * b)), 12)
            top, tau = -math.inf, 1.0
            for _, tx, ty, _, r, base, crown, t in trees:
                along, aside = (tx - x) * dx + (ty - y) * dy, abs((tx - x) * dy - (ty - y) * dx)
                if aside <= r and 0 < along <= 400:
                    top = max(top, (crown - 1.1) / max(along, .01))
                    if base <= 1.1 + along * math.tan(math.radians(30)) <= crown:
                        tau *= max(t, 1e-6)
            assert got[i]["canopy"][b] == max(0, round(math.degrees(math.atan(top))))
            assert got[i]["tau_q"][b] == round(tau * 255)


def test_hot_cells_are_split_without_changing_the_result(spark):
    points = spark.range(0, 3000).select(F.col("id").alias("pid"), (F.rand(1) * 10).alias("x"), (F.rand(2) * 10).alias("y"))
    boxes = spark.range(0, 50).select(F.col("id").alias("bid"), (F.rand(3) * 10).alias("u"), (F.rand(4) * 10).alias("v"))
    right = box_cells(boxes, F.col("u") - 2, F.col("v") - 2, F.col("u") + 2, F.col("v") + 2, 10.0)
    near = (F.abs(F.col("x") - F.col("u")) <= 2) & (F.abs(F.col("y") - F.col("v")) <= 2)
    left = point_cells(points, "x", "y", 10.0)
    plain = cell_join(left, right, "pid", near, pairs_per_task=None)
    split = cell_join(left, right, "pid", near, pairs_per_task=5000)
    assert split.select("salt").distinct().count() > 8
    assert sorted(plain.select("pid", "bid").collect()) == sorted(split.select("pid", "bid").collect())


def join_names(df):
    return [line.strip(" :+-*").split()[0] for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line or "CoGroup" in line]


def test_cell_joins_never_broadcast_exploded_boxes(spark):
    """The planner sizes a box as one row, however many cells it is exploded to, and used to send them all to the driver."""
    samples, buildings = scene()
    points, prisms = spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(buildings, BUILDINGS)
    assert join_names(H.wall_pairs(points, prisms, facing_only=False))[0] == "SortMergeJoin"
    assert join_names(H.wall_pairs(points, prisms, "left"))[0] == "SortMergeJoin"


def test_horizons_make_no_row_per_pair_and_hot_cells_are_split(spark, monkeypatch):
    samples, buildings = scene()
    points, prisms = spark.createDataFrame(samples + samples[:5], SAMPLES), spark.createDataFrame(buildings, BUILDINGS)
    whole = H.building_horizon(points, prisms)
    assert "FlatMapCoGroupsInArrow" in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(H, "PAIRS_PER_CELL", 500)
    monkeypatch.setattr(H, "PAIRS_AT_ONCE", 100)
    split = H.building_horizon(points, prisms)
    assert sorted(whole.collect()) == sorted(split.collect()) and whole.count() == len(samples)


def test_samples_without_a_place_or_a_neighbour_keep_a_row(spark):
    points = spark.createDataFrame([(0, None, 1.0), (1, 5.0, 5.0)], SAMPLES)
    far = spark.createDataFrame([(0, 9000.0, 9000.0, "x", 3.0, 2.0, 9.0, .1)], TREES)
    rows = H.canopy_horizon(points, far).collect()
    assert sorted(r["sample_id"] for r in rows) == [0, 1]
    assert all(set(r["canopy"]) == {0} and set(r["tau_q"]) == {255} for r in rows)


def test_beams_look_no_farther_than_the_lowest_sun_lets_shadows_fall(spark):
    rng = random.Random(8)
    samples, buildings = scene()
    prisms = spark.createDataFrame([*buildings, (200, 300.0, [square(500, 0, 20)])], BUILDINGS)
    crowns = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), "Acer rubrum", rng.uniform(1, 9), rng.uniform(2, 5), rng.uniform(6, 25), .5) for i in range(300)]
    trees = spark.createDataFrame(crowns, TREES)
    rows = [(i, x, y, rng.uniform(0, 360), rng.choice([25.0, 40.0, 70.0])) for i, x, y in [*samples, (103, 320.0, 0.0)]]
    points = spark.createDataFrame(rows, f"{SAMPLES}, azimuth_deg double, elevation_deg double")
    lowest = H.lowest_sun(points)
    assert H.wall_boxes(prisms, lowest).count() < H.wall_boxes(prisms).count()
    assert H.crown_boxes(trees, lowest).count() < H.crown_boxes(trees).count()
    every = E.beam_buildings(points, prisms).join(points.select("sample_id", "elevation_deg"), "sample_id").filter("angle_deg > elevation_deg").collect()
    best = {}
    for r in every:
        best[r["sample_id"]] = max(best.get(r["sample_id"], (-1, 0)), (r["angle_deg"], -r["building_id"]))
    got = {r["sample_id"]: r["building_id"] for r in E.blocking_building(points, prisms).collect()}
    assert got == {k: -v[1] for k, v in best.items()} and got
    through = {r["sample_id"]: r["transmittance"] for r in E.canopy_transmittance(points, trees).collect()}
    for i, x, y, az, el in rows:
        dx, dy, tau = math.sin(math.radians(az)), math.cos(math.radians(az)), 1.0
        for _, tx, ty, _, r, base, top, t in crowns:
            along, aside = (tx - x) * dx + (ty - y) * dy, abs((tx - x) * dy - (ty - y) * dx)
            if aside <= r and 0 < along <= 400 and base <= 1.1 + along * math.tan(math.radians(el)) <= top:
                tau *= t
        assert math.isclose(through[i], tau)
