import random

import pytest
from pyspark.sql import functions as F

from calorway.functions import radiation as R
from calorway.functions import utci as U
from calorway.functions.solar import with_sun
from calorway.functions.shade import f_sun, sky_view
from calorway.operators import evidence as E
from calorway.operators import exposure as X
from calorway.session import materialize

# fixed values: published UTCI results (air, radiant, wind, humidity -> index)
UTCI_GOLDEN = [
    (0.0, 0.0, 0.5, 50.0, 0.7), (30.0, 60.0, 1.0, 50.0, 38.0), (25.0, 25.0, 1.0, 50.0, 24.6), (32.0, 55.0, 5.0, 45.0, 34.7),
    (35.5, 41.4, 3.5, 60.0, 38.4), (30.6, 62.0, 2.0, 48.0, 38.0), (30.6, 34.0, 2.0, 48.0, 31.1), (-10.0, -15.0, 8.0, 70.0, -36.8),
]
# fixed values: epoch second -> azimuth, elevation in Manhattan
SUN_GOLDEN = [(1753210800, 239.29, 57.59), (1766325600, 139.33, 14.19), (1753185600, 83.18, 23.73)]


def weather_rows(spark, rows):
    return spark.createDataFrame(rows, "air_temp_c double, tmrt_c double, wind_speed_10m_ms double, relative_humidity_pct double, want double")


def test_utci_matches_published_values(spark):
    out = U.with_weather_curve(weather_rows(spark, UTCI_GOLDEN)).withColumn("got", U.utci_exact(F.col("tmrt_c")))
    for row in out.collect():
        assert row["got"] == pytest.approx(row["want"], abs=0.1)


def test_lookup_stays_close_to_polynomial(spark):
    hours = U.with_weather_curve(weather_rows(spark, UTCI_GOLDEN)).drop("tmrt_c")
    grid = spark.range(0, 900).select((F.col("id") / 10.0 - 10.0).alias("tmrt_c"))
    both = U.with_feels_like(hours.crossJoin(grid)).withColumn("exact", U.utci_exact(F.col("tmrt_c")))
    assert both.agg(F.max(F.abs(F.col("feels_like_c") - F.col("exact")))).first()[0] < 0.05


def test_sun_position(spark):
    rows = spark.createDataFrame(SUN_GOLDEN, "epoch_s long, az double, el double").withColumns({"lat": F.lit(40.7580), "lon": F.lit(-73.9855)})
    for row in with_sun(rows).collect():
        assert row["azimuth_deg"] == pytest.approx(row["az"], abs=0.5)
        assert row["elevation_deg"] == pytest.approx(row["el"], abs=0.5)


def sky(spark, **over):
    base = dict(air_temp_c=30.0, relative_humidity_pct=50.0, cloud_cover_pct=0.0, direct_normal_wm2=800.0, diffuse_wm2=150.0, global_horizontal_wm2=700.0)
    return R.with_sky(spark.createDataFrame([{**base, **over}]))


def tmrt_of(df, f, svf):
    return df.select(R.tmrt(F.lit(f), F.lit(svf), F.lit(0.2))).first()[0]


def test_tmrt_closed_box_and_monotone(spark):
    dark = sky(spark, direct_normal_wm2=0.0, diffuse_wm2=0.0, global_horizontal_wm2=0.0)
    assert tmrt_of(dark, 0.0, 0.0) == pytest.approx((0.95 ** 0.25) * 303.15 - 273.15, abs=0.01)
    day = sky(spark)
    lit = [tmrt_of(day, f, 0.7) for f in (0.0, 0.25, 0.5, 1.0)]
    assert lit == sorted(lit) and lit[-1] - lit[0] > 10


def test_shade_lookup_and_sky_view(spark):
    flat, wall = [0] * 72, [0] * 36 + [45] * 36
    rows = spark.createDataFrame([(flat, flat, [255] * 72), (wall, flat, [255] * 72), (flat, [60] * 72, [51] * 72)],
                                 "opaque array<smallint>, canopy array<smallint>, tau_q array<smallint>")
    rows = rows.withColumns({"az_low": F.lit(55), "az_high": F.lit(56), "az_weight": F.lit(0.5), "elevation_deg": F.lit(30.0)})
    assert [round(r[0], 3) for r in rows.select(f_sun()).collect()] == [1.0, 0.0, 0.2]
    assert rows.select(sky_view(F.col("opaque"))).collect()[1][0] == pytest.approx(0.75)
    assert rows.withColumn("elevation_deg", F.lit(-1.0)).select(f_sun()).distinct().collect()[0][0] == 0.0


def below(plan, line_no):
    """Lines of a plan tree that hang under one of its lines."""
    depth = len(plan[line_no]) - len(plan[line_no].lstrip(" :+-"))
    out = []
    for line in plan[line_no + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        out.append(line)
    return out


def test_sample_arrays_are_not_shuffled_per_instant(spark):
    """Keys meet the moments before the samples, so no exchange by minute carries a horizon."""
    keys = spark.createDataFrame([(1, 28421580, 3600), (1, 28421640, 3600), (2, 28421580, 3600)], "edge_id long, minute long, hour_s long")
    flat = F.array(*[F.lit(0).cast("short")] * 72)
    shaded = spark.createDataFrame([(10, 1, 0.25, 1.0), (11, 1, 0.25, 1.0), (20, 2, 0.25, 1.0), (30, 3, 0.25, 1.0)], "sample_id long, edge_id long, ground_albedo double, svf double").select(
        "*", flat.alias("opaque"), flat.alias("canopy"), flat.alias("tau_q"))
    weather = spark.createDataFrame([(3600, 25.0, 40.0, 2.0, 0.0, 600.0, 100.0, 500.0)],
                                    "hour_s long, air_temp_c double, relative_humidity_pct double, wind_speed_10m_ms double, cloud_cover_pct double, "
                                    "direct_normal_wm2 double, diffuse_wm2 double, global_horizontal_wm2 double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = X.sample_panel(keys, shaded, X.instants(keys, weather, 40.758, -73.9855))
        plan = rows._jdf.queryExecution().sparkPlan().toString().split("\n")
        joins = [k for k, line in enumerate(plan) if "SortMergeJoin" in line and "minute" in line]
        assert joins and not any("opaque" in line for k in joins for line in below(plan, k))
        got = sorted((r["edge_id"], r["minute"], r["sample_id"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(1, 28421580, 10), (1, 28421580, 11), (1, 28421640, 10), (1, 28421640, 11), (2, 28421580, 20)]


def test_sky_view_of_whole_short_and_null_horizons(spark):
    rows = spark.createDataFrame([(1, [90] * 36 + [0] * 36), (2, [90] * 36), (3, None), (4, [90] * 71 + [None])], "id long, opaque array<smallint>")
    got = {r["id"]: r["svf"] for r in rows.select("id", sky_view(F.col("opaque")).alias("svf")).collect()}
    assert got[1] == 0.5 and got[2] == 0.5 and got[3] is None and got[4] is None


def exploded_broadcasts(df):
    """Generate nodes under some BroadcastExchange of the plan."""
    lines = [(len(line) - len(line.lstrip(" :+-*")), line) for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    found = []
    for i, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            found += [text for _, text in lines[i + 1:below] if "Generate" in text]
    return found


def lit_samples(spark, edges=6):
    rng = random.Random(11)
    rows = [(e * 9 + i, e, 0.2, [rng.choice([0, 10, 25, 60]) for _ in range(72)], [rng.choice([0, 40]) for _ in range(72)], [rng.choice([40, 200]) for _ in range(72)], 0.7) for e in range(edges) for i in range(3)]
    return materialize(spark.createDataFrame(rows, "sample_id long, edge_id long, ground_albedo double, opaque array<smallint>, canopy array<smallint>, tau_q array<smallint>, svf double"), "lit")


def test_steps_of_asks_stay_with_their_edge(spark):
    """Each ask was exploded to its 73 instants first, which the planner took for one row and sent to the driver."""
    start = 1705294800 + 9 * 3600
    rows = [(i, i % 6, start + 900 * (i % 5) + (i % 3) * 17) for i in range(40)] + [(99, 77, start)]
    asks = materialize(spark.createDataFrame(rows, "ask_id long, edge_id long, at_s long"), "asks")
    shaded = lit_samples(spark)
    out = E.sunlit_until(asks, shaded, 40.758, -73.9855)
    assert not exploded_broadcasts(out)
    steps = spark.createDataFrame([(i * 100 + k, e, at + 300 * k, 40.758, -73.9855) for i, e, at in rows for k in range(73)], "ask_id long, edge_id long, epoch_s long, lat double, lon double")
    means = {r["ask_id"]: r["mean_f_sun"] for r in E.mean_f_sun(with_sun(steps), shaded).collect()}
    want = {}
    for i, e, at in rows[:40]:
        k = next((k for k in range(73) if means[i * 100 + k] <= 0.5), 0)
        want[i] = at + 300 * k if k else None
    assert {r["ask_id"]: r["until_s"] for r in out.collect()} == want and any(want.values())


def test_samples_listed_from_edges_are_not_broadcast_and_panels_agree(spark, monkeypatch):
    edges = materialize(spark.range(6).withColumnRenamed("id", "edge_id"), "edges")
    listed = edges.select("edge_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    samples = listed.select((F.col("edge_id") * 9 + F.col("i")).alias("sample_id"), "edge_id", F.lit(0.2).alias("ground_albedo"))
    shaded = X.shaded_samples(samples, lit_samples(spark).select("sample_id", "opaque", "canopy", "tau_q"))
    assert not exploded_broadcasts(shaded)
    weather = spark.createDataFrame([(7, 30.0, 50.0, 2.0, 40.0, 600.0, 120.0, 700.0)], "hour_s long, air_temp_c double, relative_humidity_pct double, wind_speed_10m_ms double, "
                                    "cloud_cover_pct double, direct_normal_wm2 double, diffuse_wm2 double, global_horizontal_wm2 double")
    keys = spark.createDataFrame([(e, (1705294800 + 43200) // 60 + m, 7) for e in range(6) for m in (0, 0, 90)], "edge_id long, minute long, hour_s long")
    moments = X.instants(keys, weather, 40.758, -73.9855)
    few = sorted(X.sample_panel(keys, shaded, moments).collect())
    monkeypatch.setattr(X, "FEW_MOMENTS", 0)
    assert few == sorted(X.sample_panel(keys, shaded, moments).collect()) and len(few) == 36
