"""Steps whose cost must not grow faster than their input: what is shuffled, over how many tasks, and with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from calorway import session
from calorway.operators import evidence as E
from calorway.operators import graph as GR
from calorway.operators import horizon as H
from calorway.operators import maps as M
from calorway.operators.cells import box_cells, cell_join, point_cells
from calorway.operators.numbering import contiguous_ids
from calorway.plans import graph_queries as GQ


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning") + plan_of(df).count("Exchange rangepartitioning")


def test_rows_are_numbered_without_a_second_shuffle(spark):
    rng = random.Random(4)
    keys = [(rng.randrange(10 ** 6), f"r{k}") for k in range(900)] + [(None, "none")]
    got = contiguous_ids(spark.createDataFrame(keys, "k long, name string").repartition(7), "n", ["k", "name"])
    ordered = sorted(keys, key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [(r["k"], r["name"]) for r in got.orderBy("n").collect()] == ordered
    assert sorted(r["n"] for r in got.collect()) == list(range(901))
    assert "Window" not in plan_of(got.select("n", "name")).split("BroadcastExchange")[0]


def test_samples_are_made_over_all_tasks(spark):
    path = "array<struct<x:double,y:double>>"
    paths = [(k, [(0.0, 0.0), (10.0 + k, 0.0)] if k % 2 else [(0.0, 0.0), (5.0, 0.0), (5.0, 7.0 + k)]) for k in range(40)]
    edges = spark.createDataFrame(paths, f"edge_id long, path {path}").coalesce(1).withColumn("length_m", F.col("edge_id") + 12.0)
    got = GR.sample_points(GR.with_sample_blocks(edges).coalesce(1))
    assert got.rdd.getNumPartitions() >= 4
    rows = {(r["edge_id"], r["t"]): (r["x_m"], r["y_m"]) for r in got.collect()}
    assert len(rows) == got.count() and rows[(3, 0.0)] == (0.0, 0.0) and rows[(3, 1.0)] == (13.0, 0.0) and rows[(4, 1.0)] == pytest.approx((5.0, 11.0))
    assert rows[(1, 0.5)] == (5.5, 0.0) and rows[(0, 0.0)] == (0.0, 0.0) and rows[(0, 0.5)] == (5.0, 1.0)


def points_and_boxes(spark, n=300):
    rng = random.Random(5)
    points = spark.createDataFrame([(k, rng.uniform(0, 500), rng.uniform(0, 500)) for k in range(n)], "pid long, x double, y double")
    boxes = spark.createDataFrame([(k, rng.uniform(0, 500), rng.uniform(0, 500)) for k in range(n)], "bid long, bx double, by double")
    b = box_cells(boxes, F.col("bx") - 20, F.col("by") - 20, F.col("bx") + 20, F.col("by") + 20, 50.0)
    return point_cells(points, "x", "y", 50.0), b, (F.abs(F.col("x") - F.col("bx")) <= 20) & (F.abs(F.col("y") - F.col("by")) <= 20)


def test_a_cell_join_without_hot_cells_shuffles_each_side_once(spark):
    left, right, near = points_and_boxes(spark)
    assert shuffles(cell_join(left, right, "pid", near)) == 2


def test_large_cell_joins_get_more_tasks(spark, monkeypatch):
    left, right, near = points_and_boxes(spark)
    want = sorted(cell_join(left, right, "pid", near).select("pid", "bid").collect())
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    for pairs in (50_000_000, 40):
        many = cell_join(left, right, "pid", near, pairs_per_task=pairs)
        assert many.rdd.getNumPartitions() > 5
        assert sorted(many.select("pid", "bid").collect()) == want and len(want) > 300


def test_nearest_street_in_many_tasks(spark, monkeypatch):
    rng = random.Random(6)
    ring = "array<array<struct<x:double,y:double>>>"
    prints = [(k, [[(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4), (x, y)]]) for k in range(60) for x, y in [(rng.uniform(0, 900), rng.uniform(0, 900))]]
    spots = [(k, k // 3, rng.uniform(0, 900), rng.uniform(0, 900)) for k in range(150)] + [(7, 99, 1.0, 1.0)]
    f = spark.createDataFrame(prints, f"building_id long, rings {ring}")
    s = spark.createDataFrame(spots, "sample_id long, edge_id long, x_m double, y_m double")
    e = spark.createDataFrame([(k, f"s{k}") for k in range(50)], "edge_id long, street_name string")
    plain = sorted(map(str, E.nearest_street(f, s, e).collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    assert sorted(map(str, E.nearest_street(f, s, e).collect())) == plain and len(plain) >= 60


def test_crossing_rounds_carry_links_only(spark, monkeypatch):
    written = []
    keep = GR.materialize
    monkeypatch.setattr(GR, "materialize", lambda df, label, *a: written.append(label) or keep(df, label, *a))
    links = [(20.0 + (k * 7 % 13), k, k + 1, k, k + 1) for k in range(40)] + [(39.0, 0, 40, 0, 40)]
    got = GR.select_crossings(spark.createDataFrame(links, "span_m double, i long, j long, u long, v long"))
    assert sorted(r["i"] for r in got.collect()) == sorted(range(40)) and got.filter("span_m = 39").isEmpty()
    assert written.count("label") == 1 and written.count("best") > 1


def test_hulls_of_a_batch(spark):
    rng = random.Random(7)
    sets = [[(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(n)] for n in (0, 1, 2, 3, 4, 10, 10, 50, 700)] + [None, [(None, None)], [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, o array<struct<x:double,y:double>>")
    got = {r["k"]: r["h"] for r in df.select("k", M.convex_hull(F.col("o")).alias("h")).collect()}
    for k, points in enumerate(sets):
        if points is None:
            assert got[k] is None
            continue
        known = sorted({p for p in points if p[0] is not None})
        hull = [tuple(p) for p in got[k]]
        assert len(set(hull)) == len(hull) and set(hull) <= set(known) and hull[:1] == known[:1]
        ends = list(zip(hull, hull[1:] + hull[:1]))
        # every point lies left of every side, and no corner is straight
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in ends for p in known)
        if len(hull) > 2:
            assert all((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0 for (a, b), (_, c) in zip(ends, ends[1:] + ends[:1]))


def test_horizon_cells_are_dealt_by_their_pairs(spark, monkeypatch):
    rng = random.Random(8)
    samples = spark.createDataFrame([(k, rng.uniform(0, 2000), rng.uniform(0, 2000)) for k in range(400)], "sample_id long, x_m double, y_m double")
    trees = spark.createDataFrame([(k, rng.uniform(0, 2000), rng.uniform(0, 2000), "Tilia", 4.0, 3.0, 12.0, 0.1) for k in range(300)],
                                  "tree_id long, x_m double, y_m double, species string, crown_radius_m double, crown_base_m double, crown_top_m double, tau double")
    want = H.canopy_horizon(samples, trees).orderBy("sample_id").collect()
    monkeypatch.setattr(H, "PAIRS_PER_CELL", 400)
    many = H.canopy_horizon(samples, trees)
    # the runtime joins partitions that are small in bytes, and these are all small
    assert many.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert many.orderBy("sample_id").collect() == want and len(want) == 400
    assert H.canopy_horizon(samples.limit(0), trees).count() == 0


def test_a_source_fingerprint_builds_only_the_tables_it_reads(spark, monkeypatch):
    asked = []
    table = spark.createDataFrame([(1,)], "a int")
    monkeypatch.setattr(GQ, "city_table", lambda spark, sf, name: asked.append(name) or table)
    assert GQ.source_fingerprint(spark, "none").count() == 1
    assert sorted(asked) == ["buildings", "samples", "trees"]
