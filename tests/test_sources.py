import json

import pytest
from pyspark.sql import functions as F

from calorway.functions.projection import to_degrees, to_metres
from calorway.sources import feeds


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


def feature(props, kind=None, coords=None):
    return {"type": "Feature", "properties": props, "geometry": None if kind is None else {"type": kind, "coordinates": coords}}


def test_projection_known_point_and_back(spark):
    x, y = to_metres(F.lit(-73.985), F.lit(40.75))
    lon, lat = to_degrees(x, y)
    row = spark.range(1).select(x, y, lon, lat).first()
    assert row[0] == pytest.approx(301266.780, abs=1e-2) and row[1] == pytest.approx(64776.909, abs=1e-2)
    assert row[2] == pytest.approx(-73.985, abs=1e-9) and row[3] == pytest.approx(40.75, abs=1e-9)


def test_streets_are_filtered_and_split(spark, tmp_path):
    def street(pid, rw, borough, kind, coords):
        return feature({"physicalid": pid, "full_street_name": "W 42ND ST", "boroughcode": borough, "rw_type": rw, "streetwidth": "70"}, kind, coords)
    inside, outside = [[-73.99, 40.75], [-73.98, 40.75]], [[-73.90, 40.85], [-73.89, 40.85]]
    path = collection(tmp_path / "s.geojson", [
        street("1", "1", "1", "LineString", inside), street("2", "2", "1", "LineString", inside), street("3", "1", "3", "LineString", inside),
        street("4", "1", "1", "MultiLineString", [inside, outside])])
    rows = feeds.read_streets(spark, path, "midtown", collection=True).collect()
    assert sorted((r["physical_id"], r["seq"]) for r in rows) == [(1, 0), (4, 1)]
    assert rows[0]["street_name"] == "W 42Nd St" and rows[0]["street_width_m"] == pytest.approx(21.336)


def test_buildings_need_every_borough(spark, tmp_path):
    ring = [[[-73.99, 40.75], [-73.989, 40.75], [-73.989, 40.751], [-73.99, 40.75]]]
    path = collection(tmp_path / "b.geojson", [
        feature({"bin": "1", "height_roof": 328.084, "feature_code": "2100"}, "Polygon", ring),
        feature({"bin": "2", "height_roof": 0, "feature_code": "2100"}, "Polygon", ring),
        feature({"bin": "3", "height_roof": 90, "feature_code": "9999"}, "Polygon", ring)])
    rows = feeds.read_buildings(spark, {"1": path}, "midtown", collection=True).collect()
    assert [(r["bin"], round(r["height_m"], 3), r["base_m"]) for r in rows] == [("1", 100.0, 0.0)]
    with pytest.raises(ValueError):
        feeds.read_buildings(spark, {"1": path}, "manhattan_brooklyn", collection=True)


def test_trees_take_points_from_columns(spark, tmp_path):
    def tree(status, dbh, **more):
        return feature({"longitude": "-73.98", "latitude": "40.75", "borocode": "1", "status": status, "tree_dbh": dbh, **more})
    path = collection(tmp_path / "t.geojson", [tree("Alive", 10, spc_latin="Acer rubrum"), tree("Dead", 10), tree("Alive", 400)])
    rows = sorted((r["species"], round(r["dbh_cm"], 2)) for r in feeds.read_trees(spark, path, "midtown", collection=True).collect())
    assert rows == [("", 152.4), ("Acer rubrum", 25.4)]


def test_places_in_both_shapes(spark, tmp_path):
    a = collection(tmp_path / "f.geojson", [feature({"propertyna": " Bryant Park ", "name": ""}, "Point", [-73.98, 40.75])])
    b = tmp_path / "c.json"
    b.write_text(json.dumps([{"x": "-73.97", "y": "40.76", "site_name": "Library"}, {"x": "-73.96", "y": None}]))
    got = feeds.read_places(spark, a, 0, whole_file=True).union(feeds.read_places(spark, str(b), 1, whole_file=True)).collect()
    assert [(r["kind"], r["name"], r["lon"]) for r in got] == [(0, "Bryant Park", -73.98), (1, "Library", -73.97)]


def test_weather_payload_and_fallback(spark, tmp_path):
    names = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover", "direct_normal_irradiance", "diffuse_radiation", "shortwave_radiation", "uv_index"]
    good = tmp_path / "w.json"
    good.write_text(json.dumps({"hourly": {"time": ["2025-07-22T15:00", "2025-07-22T16:00"], **{n: [36.0, 18.0] for n in names}}}))
    rows = feeds.read_weather_hours(spark, str(good), whole_file=True).orderBy("hour_s").collect()
    assert rows[0]["hour_s"] == 1753210800 and rows[0]["wind_speed_10m_ms"] == pytest.approx(10.0) and rows[1]["air_temp_c"] == 18.0
    bad = tmp_path / "x.json"
    bad.write_text("{}")
    row = feeds.read_weather_hours(spark, str(bad), whole_file=True).first()
    assert row["hour_s"] is None and row["air_temp_c"] == 32.0 and row["source"].startswith("fallback")


def test_missing_parks_feed_is_empty(spark, tmp_path):
    assert feeds.read_parks(spark, str(tmp_path / "none.geojson"), "midtown").count() == 0


def test_weather_ignores_the_session_zone_and_splits_the_autumn_hour(spark, tmp_path):
    import json
    stamps = ["2025-11-02T00:00", "2025-11-02T01:00", "2025-11-02T01:00", "2025-11-02T02:00", "2026-07-01T12:00"]
    names = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover", "direct_normal_irradiance", "diffuse_radiation", "shortwave_radiation", "uv_index"]
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"hourly": {"time": stamps, **{n: [1.0] * 5 for n in names}}}))
    got = {}
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got[zone] = sorted(r["hour_s"] for r in feeds.read_weather_hours(spark, str(path)).collect())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    first = 1762056000  # 2025-11-02 04:00 UTC
    assert got["UTC"] == got["Asia/Tokyo"] == [first, first + 3600, first + 7200, first + 10800, 1782921600]


def test_crossing_rings_are_not_buildings(spark):
    from calorway.functions import geometry as G
    rings = {"square": [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], "bow": [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], "triangle": [(0, 0), (4, 0), (0, 4), (0, 0)],
             "loop": [(0, 0), (4, 0), (4, 4), (2, -1), (0, 4), (0, 0)]}
    df = spark.createDataFrame([(n, [tuple(map(float, p)) for p in r]) for n, r in rings.items()], "name string, ring array<struct<x:double,y:double>>")
    got = dict(map(tuple, df.select("name", G.ring_is_simple(df["ring"])).collect()))
    assert got == {"square": True, "bow": False, "triangle": True, "loop": False}


def test_repeated_and_missing_street_ids_keep_their_streets(spark, tmp_path):
    line = [[-73.99, 40.75], [-73.98, 40.75]]
    many = [[[-73.99, 40.75 + k / 1e4], [-73.98, 40.75 + k / 1e4]] for k in range(66)]
    def street(pid, kind, coords):
        return feature({"physicalid": pid, "full_street_name": "A", "boroughcode": "1", "rw_type": "1", "streetwidth": "30"}, kind, coords)
    path = collection(tmp_path / "s.geojson", [street("7", "LineString", line), street("7", "LineString", [[-73.99, 40.76], [-73.98, 40.76]]),
                                               street(None, "LineString", [[-73.99, 40.755], [-73.98, 40.755]]), street("8", "MultiLineString", many)])
    rows = feeds.read_streets(spark, path, "midtown", collection=True).collect()
    assert sorted(r["seq"] for r in rows) == list(range(len(rows))) and len(rows) == 69


def test_the_middle_of_a_line_is_computed_once_for_all_island_boxes(spark):
    from calorway.functions.projection import to_metres
    from calorway.sources.feeds import exclude_islands
    ends = [(0, -73.95, 40.76), (1, -73.80, 40.76), (2, None, None)]
    places = spark.createDataFrame(ends, "seq long, lon double, lat double")
    x, y = to_metres(F.col("lon"), F.col("lat"))
    point = F.struct(x.alias("x"), y.alias("y"))
    lines = places.select("seq", F.when(F.col("lon").isNotNull(), F.array(point, point)).alias("path"))
    kept = exclude_islands(lines)
    # the walk along the line is one fold, its length and the latitude one more each
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4
    assert [r["seq"] for r in kept.collect()] == [1]
