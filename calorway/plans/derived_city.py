"""A grid city derived from the benchmark tables with integer arithmetic.

customer -> street corners (two nodes each), orders -> trees, part -> buildings,
supplier -> amenities, events -> hourly weather, customer -> trips. Everything
grows with the tables, and the same rules are stated in SQL in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_ALBEDO, DEFAULT_LANDCOVER_CLASS
from ..functions.geometry import path_bearing, path_length, path_of
from ..functions.projection import to_degrees
from ..operators.scene import crown_columns, species_tau
from ..session import spread

X0, Y0, BLOCK_M, INSET_M = 300000, 64000, 80, 8
# 2024-01-15 00:00 in New York, as epoch seconds
DAY_START_S = 1705294800
SITE_LAT, SITE_LON = 40.7580, -73.9855
SPECIES = ("Quercus palustris", "Gleditsia triacanthos var. inermis", "Ulmus americana",
           "Acer platanoides", "Unknownia rara", "Betula  pendula 'Youngii'")


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """One row: corner count and corners per row."""
    n = F.count(F.lit(1))
    return read(spark, sf, "customer").agg(n.alias("n"), F.floor(F.sqrt(n)).cast("long").alias("w"))


def corners(spark: SparkSession, sf: str) -> DataFrame:
    k, w = F.col("c_custkey"), F.col("w")
    grid = spread(read(spark, sf, "customer").select("c_custkey"), "c_custkey").crossJoin(F.broadcast(_grid(spark, sf)))
    row = F.floor(k / w).cast("long")
    return grid.select(k.alias("k"), "n", "w", (k % w).alias("col"), row.alias("row"),
                       F.when(row < F.floor(w / 2), "1").otherwise("3").alias("borough"))


def _node_x(col: Column, s: Column) -> Column:
    return (F.lit(X0) + col * BLOCK_M + F.when(s == 0, -INSET_M).otherwise(INSET_M)).cast("double")


def _node_y(row: Column, s: Column) -> Column:
    return (F.lit(Y0) + row * BLOCK_M + F.when(s == 0, INSET_M).otherwise(-INSET_M)).cast("double")


def nodes(spark: SparkSession, sf: str, geographic: bool = True) -> DataFrame:
    s = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    out = corners(spark, sf).select("*", s).select(
        (F.col("k") * 2 + F.col("s")).alias("node_id"), _node_x(F.col("col"), F.col("s")).alias("x_m"),
        _node_y(F.col("row"), F.col("s")).alias("y_m"), F.lit(True).alias("is_intersection"), "borough")
    if not geographic:
        return out
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    return out.withColumns({"lon": lon, "lat": lat})


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Street blocks: dir 0 runs east, 1 runs north. None joins two boroughs."""
    c = corners(spark, sf)
    split = F.floor(F.col("w") / 2)
    east = c.filter((F.col("col") < F.col("w") - 1) & (F.col("k") + 1 < F.col("n")))
    north = c.filter((F.col("k") + F.col("w") < F.col("n")) & (F.col("row") != split - 1))
    east = east.select("*", F.lit(0).alias("dir"), F.lit(1).cast("long").alias("dc"), F.lit(0).cast("long").alias("dr"))
    north = north.select("*", F.lit(1).alias("dir"), F.lit(0).cast("long").alias("dc"), F.lit(1).cast("long").alias("dr"))
    name = F.when(F.col("dir") == 0, F.concat(F.lit("Row "), F.col("row"), F.lit(" Street"))).otherwise(
        F.concat(F.lit("Column "), F.col("col"), F.lit(" Avenue")))
    return east.unionByName(north).withColumn("street_name", name).withColumn(
        "physical_id", F.col("k") * 2 + F.col("dir"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Sidewalks on both sides of every block, and one crossing per corner.

    edge_id follows from block and side, so it is stable but has gaps;
    operators.graph.number_edges gives contiguous ids.
    """
    s = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    b = blocks(spark, sf).select("*", s)
    k2 = F.col("k") + F.col("dc") + F.col("dr") * F.col("w")
    side = b.select(
        ((F.col("dir") * F.col("n") + F.col("k")) * 2 + F.col("s")).alias("seq"),
        (F.col("k") * 2 + F.col("s")).alias("u"), (k2 * 2 + F.col("s")).alias("v"),
        F.lit(0).cast("short").alias("kind"), F.col("s").cast("byte").alias("side"),
        "street_name", "physical_id",
        path_of((_node_x(F.col("col"), F.col("s")), _node_y(F.col("row"), F.col("s"))),
                (_node_x(F.col("col") + F.col("dc"), F.col("s")),
                 _node_y(F.col("row") + F.col("dr"), F.col("s")))).alias("path"))
    cross = corners(spark, sf).select(
        (F.col("n") * 4 + F.col("k")).alias("seq"), (F.col("k") * 2).alias("u"), (F.col("k") * 2 + 1).alias("v"),
        F.lit(1).cast("short").alias("kind"), F.lit(-1).cast("byte").alias("side"),
        F.concat(F.lit("Row "), F.col("row"), F.lit(" Street / Column "), F.col("col"), F.lit(" Avenue")).alias("street_name"),
        F.lit(-1).cast("long").alias("physical_id"),
        path_of((_node_x(F.col("col"), F.lit(0)), _node_y(F.col("row"), F.lit(0))),
                (_node_x(F.col("col"), F.lit(1)), _node_y(F.col("row"), F.lit(1)))).alias("path"))
    both = side.unionByName(cross)
    return both.select(
        F.col("seq").alias("edge_id"), "u", "v", "kind", "side", "street_name", "physical_id",
        path_bearing(F.col("path")).alias("bearing_deg"), path_length(F.col("path")).alias("length_m"),
        F.lit(None).cast("float").alias("width_m"), "path")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Points every ten metres: nine on a sidewalk, four on a crossing.

    sample_id is edge_id * 9 + position, so ids need no numbering pass here.
    """
    e = edges(spark, sf)
    last = F.when(F.col("kind") == 0, 8).otherwise(3)
    i = F.explode(F.sequence(F.lit(0), last)).alias("i")
    t = F.col("i") / F.when(F.col("kind") == 0, 8.0).otherwise(3.0)
    a, b = F.col("path")[0], F.col("path")[1]
    return e.select("edge_id", "kind", "path", i).select(
        (F.col("edge_id") * 9 + F.col("i")).alias("sample_id"), "edge_id", t.alias("t"),
        (a["x"] + (b["x"] - a["x"]) * t).alias("x_m"), (a["y"] + (b["y"] - a["y"]) * t).alias("y_m"),
        F.lit(DEFAULT_ALBEDO).alias("ground_albedo"), F.lit(DEFAULT_LANDCOVER_CLASS).cast("short").alias("landcover_class"))


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    p, w = F.col("p_partkey"), F.col("w")
    part = spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").crossJoin(F.broadcast(_grid(spark, sf)))
    special = F.when(p % 97 == 0, 1).otherwise(0)
    cx = F.lit(X0) + (p % w) * BLOCK_M + 40
    cy = F.lit(Y0) + (F.floor(p / w) % w) * BLOCK_M + 40
    half = F.lit(20) + (p % 3) * 4 + special * 14
    part = part.select(p.alias("building_id"), (F.lit(10) + F.col("p_size") + special * 120).cast("double").alias("height_m"),
                       (p % 7).cast("double").alias("base_m"), cx.alias("cx"), cy.alias("cy"), half.alias("half"))
    x0, x1, y0, y1 = (F.col("cx") - F.col("half"), F.col("cx") + F.col("half"),
                      F.col("cy") - F.col("half"), F.col("cy") + F.col("half"))
    ring = path_of((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    return part.select("building_id", "height_m", "base_m", F.array(ring).alias("rings"))


def tree_points(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    grid = spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").crossJoin(F.broadcast(_grid(spark, sf)))
    side = F.col("w") * BLOCK_M
    names = F.array(*map(F.lit, SPECIES))
    return grid.select(
        o.alias("tree_id"), (F.lit(X0) + (o * 37) % side).cast("double").alias("x_m"),
        (F.lit(Y0) + (c * 53 + o * 11) % side).cast("double").alias("y_m"),
        F.element_at(names, (o % 6 + 1).cast("int")).alias("species"), (o % 41).cast("double").alias("dbh_cm"))


def trees(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scene import build_crowns
    return build_crowns(tree_points(spark, sf))


def amenities(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    grid = read(spark, sf, "supplier").select("s_suppkey", "s_name").crossJoin(F.broadcast(_grid(spark, sf)))
    side = F.col("w") * BLOCK_M
    out = grid.select(
        s.alias("amenity_id"), (s % 3).cast("short").alias("kind"),
        F.when(s % 4 == 0, "").otherwise(F.col("s_name")).alias("name"),
        (F.lit(X0) + (s * 97) % side).cast("double").alias("x_m"),
        (F.lit(Y0) + (s * 61) % side).cast("double").alias("y_m"))
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    return out.withColumns({"lon": lon, "lat": lat})


def epoch_seconds(ts: Column) -> Column:
    """Seconds of a zone-less timestamp, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """One row per hour that has events."""
    e = read(spark, sf, "events").select(
        (F.floor(epoch_seconds(F.col("ts")) / 3600) * 3600).cast("long").alias("hour_s"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))
    c = F.col("c")
    return e.groupBy("hour_s").agg(F.sum("cents").alias("c")).select(
        "hour_s", (F.lit(20.0) + (c % 1500) / 100.0).alias("air_temp_c"),
        (F.lit(30.0) + c % 50).alias("relative_humidity_pct"),
        (F.lit(0.5) + (c % 70) / 10.0).alias("wind_speed_10m_ms"),
        (c % 101).cast("double").alias("cloud_cover_pct"),
        (F.lit(100.0) + c % 701).alias("direct_normal_wm2"),
        (F.lit(50.0) + c % 211).alias("diffuse_wm2"),
        (F.lit(200.0) + c % 601).alias("global_horizontal_wm2"),
        (c % 11).cast("double").alias("uv_index"), F.lit("feed").alias("source"))


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """One short walk per customer: two columns and one row away, side 0 to side 0."""
    c = corners(spark, sf)
    col = F.col("col") + F.when(F.col("col") + 2 < F.col("w"), 2).otherwise(-2)
    row = F.when(F.col("row") > 0, F.col("row") - 1).otherwise(F.col("row") + 1)
    dest = row * F.col("w") + col
    return c.filter(dest < F.col("n")).select(
        F.col("k").alias("trip_id"), (F.col("k") * 2).alias("origin"), (dest * 2).alias("destination"),
        (F.lit(DAY_START_S + 13 * 3600) + (F.col("k") % 4) * 900).cast("long").alias("depart_s"))
