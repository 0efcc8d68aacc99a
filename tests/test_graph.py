import random

import pytest
from pyspark.sql import functions as F

from calorway.functions import geometry as G
from calorway.operators import checks as K
from calorway.operators import graph as GR
from calorway.operators.components import components
from calorway.operators.numbering import contiguous_ids

PATH = "array<struct<x:double,y:double>>"
STREETS = f"seq long, physical_id long, street_name string, borough string, street_width_m double, path {PATH}"


def offset(spark, points, by):
    df = spark.createDataFrame([(points,)], f"path {PATH}").withColumn("s", G.normals(F.col("path")))
    df = df.withColumn("o", G.offset_path(F.col("s"), F.lit(by))).withColumn("ok", G.offset_is_sound(F.col("path"), F.col("o")))
    row = df.first()
    return [(round(p["x"], 6), round(p["y"], 6)) for p in row["o"]], row["ok"]


def test_offsets_keep_direction_and_mitre(spark):
    assert offset(spark, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 1.0) == ([(0, 1), (9, 1), (9, 10)], True)
    assert offset(spark, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], -1.0) == ([(0, -1), (11, -1), (11, 10)], True)
    assert offset(spark, [(0.0, 0.0), (10.0, 0.0), (0.0, 0.1)], 6.0)[1] is False


def test_plus_shaped_junction_becomes_one_component(spark):
    stubs = [(1, 1, "A St", [(-60.0, 0.0), (0.0, 0.0)]), (2, 2, "A St E", [(0.0, 0.0), (60.0, 0.0)]),
             (3, 3, "B St", [(0.0, -60.0), (0.0, 0.0)]), (4, 4, "B St N", [(0.0, 0.0), (0.0, 60.0)])]
    streets = spark.createDataFrame([(s, p, n, "1", None, path) for s, p, n, path in stubs], STREETS)
    nodes, edges = GR.sidewalk_edges(streets)
    assert edges.count() == 8 and sorted(r[0] for r in nodes.select("node_id").collect()) == list(range(nodes.count()))
    full = GR.add_crossings(nodes, edges)
    assert sorted(r[0] for r in full.select("edge_id").collect()) == list(range(full.count()))
    assert components(full.select("u", "v"), nodes).select("component").distinct().count() == 1


def test_selected_crossings_equal_adding_shortest_first(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(0, 150), rng.uniform(0, 150)) for _ in range(60)]
    cands = []
    for i in range(60):
        for j in range(i + 1, 60):
            span = ((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) ** .5
            if span <= 40:
                cands.append((span, i, j))
    root = list(range(60))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    want = set()
    for span, i, j in sorted(cands):
        a, b = find(i), find(j)
        if span <= 15 or a != b:
            want.add((i, j))
        root[a] = b
    got = GR.select_crossings(spark.createDataFrame(cands, "span_m double, i long, j long"))
    assert {(r["i"], r["j"]) for r in got.collect()} == want


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(50)]
    root = {i: i for i in range(360)}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(pairs, "u long, v long"), spark.range(360).withColumnRenamed("id", "node_id"))
    assert {r["node_id"]: r["component"] for r in got.collect()} == {i: find(i) for i in range(360)}


def test_contiguous_ids_follow_the_order(spark):
    df = spark.range(0, 5000).select((F.hash("id").cast("long") * 5000 + F.col("id")).alias("k"))
    rows = contiguous_ids(df, "n", ["k"]).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(5000))


def test_samples_of_long_and_short_edges(spark):
    edges = spark.createDataFrame([(0, 100.0, [(0.0, 0.0), (100.0, 0.0)]), (1, 4.0, [(0.0, 0.0), (0.0, 4.0)])], f"edge_id long, length_m double, path {PATH}")
    got = GR.sample_points(GR.with_sample_blocks(edges)).orderBy("sample_id").collect()
    assert [r["edge_id"] for r in got] == [0] * 11 + [1] * 2
    assert [round(r["x_m"]) for r in got[:11]] == list(range(0, 101, 10)) and got[-1]["y_m"] == 4.0


def test_wkb_roundtrip(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [(0.0, 1.5), (2.0, 3.0)])],
                               f"rings array<{PATH}>, path {PATH}")
    out = df.select(G.wkb_to_rings(G.rings_to_wkb("rings")).alias("r"), G.wkb_to_line(G.line_to_wkb("path")).alias("p"), "rings", "path").first()
    assert out["r"] == out["rings"] and out["p"] == out["path"]


def test_checks_name_what_is_broken(spark):
    nodes = spark.createDataFrame([(0, "1"), (1, "1"), (2, "1")], "node_id long, borough string")
    edges = spark.createDataFrame([(0, 0, 1, 0, 0, 7, 80.0, 0, 9), (1, 1, 5, 1, -1, -1, 55.0, 8, 4)],
                                  "edge_id long, u long, v long, kind int, side int, physical_id long, length_m double, sample_start long, sample_count int")
    samples = spark.createDataFrame([(i, 0 if i < 9 else 1) for i in range(12)], "sample_id long, edge_id long")
    assert [r[0] for r in K.dangling_endpoints(nodes, edges).collect()] == [5]
    assert not K.both_sides_present(edges).first()["ok"]
    assert not K.crossing_spans(edges).first()["ok"]
    tiling = K.sample_tiling(edges, samples).first()
    assert not tiling["ok"] and "1 overlaps" in tiling["detail"]
    assert K.network_nonempty(nodes, edges, samples).first()["ok"]
    assert K.connectivity_report(nodes, edges.filter("edge_id = 0")).first()["orphan_nodes"] == 1
    problems = [r["problem"] for r in K.schema_problems("samples", samples).collect()]
    assert any("missing column t" in p for p in problems) and len(problems) == 5


@pytest.mark.parametrize("width,want", [(None, 6.0), (0.0, 6.0), (70.0, 12.668), (200.0, 20.288)])
def test_offset_for(spark, width, want):
    assert spark.range(1).select(GR.offset_for(F.lit(width).cast("double"))).first()[0] == pytest.approx(want)
