"""Feeds read back, rasters, parks, beams at one instant, plantings and map views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.projection import box_to_metres, to_degrees, to_metres
from ..functions.solar import with_sun
from ..operators import evidence as E
from ..operators import landcover as L
from ..operators import maps as M
from ..operators import parks as P
from ..operators import planting as PL
from ..operators import waypoints as WP
from ..operators.exposure import shaded_samples
from ..operators.horizon import canopy_horizon
from ..session import checkpoint_root
from ..sources import feeds
from ..streaming import plantings as ST
from . import derived_city as city
from .graph_queries import STREETS, streets
from .oracle import CTES, compose
from .registry import query, stage
from .shade_queries import horizon_table
from .thermal_queries import sun_sql

NOON_S = city.DAY_START_S + 13 * 3600


def ll_sql(source: str, x: str = "x_m", y: str = "y_m") -> str:
    """SQL adding lon and lat of projected columns."""
    return f"""SELECT * EXCLUDE (e, cone, af, rho0, t), -74.0 + degrees(atan2({x} - 300000.0, rho0 - {y}) / cone) AS lon,
        degrees(list_reduce([pi() / 2 - 2 * atan(t)] || [0.0, 0.0, 0.0, 0.0, 0.0], lambda phi, z:
          pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)))) AS lat
      FROM (SELECT *, pow(sqrt(pow({x} - 300000.0, 2) + pow(rho0 - {y}, 2)) / af, 1 / cone) AS t FROM {source}, lcc)"""


# ---- projection ----------------------------------------------------------------

@query("reproject", compose("""
    SELECT node_id::BIGINT AS node_id, round(lon, 7) AS lon, round(lat, 7) AS lat, round(x_m, 3) AS back_x, round(y_m, 3) AS back_y FROM nodes_ll""", "nodes_ll"))
def reproject(spark, sf):
    n = city.nodes(spark, sf)
    x, y = to_metres(F.col("lon"), F.col("lat"))
    return n.select("node_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round(x, 3).alias("back_x"), F.round(y, 3).alias("back_y"))


@query("bbox_to_metres", compose("""
    SELECT borough, round(min(x_m), 1) AS x0, round(max(x_m), 1) AS x1 FROM (SELECT borough, unnest([x_lo, x_hi]) AS x_m FROM (
      SELECT borough, min(x_m) AS x_lo, max(x_m) AS x_hi FROM nodes GROUP BY 1)) GROUP BY 1""", "nodes"))
def bbox_to_metres(spark, sf):
    """Bounds of a box round each borough, one metre generous, cut back to the metre."""
    b = city.nodes(spark, sf).groupBy("borough").agg(F.min("x_m").alias("a"), F.max("x_m").alias("b"), F.min("y_m").alias("c"), F.max("y_m").alias("d"))
    lon0, lat0 = to_degrees(F.col("a"), F.col("c"))
    lon1, lat1 = to_degrees(F.col("b"), F.col("c"))
    x0, _, x1, _ = box_to_metres(lon0, lat0, lon1, lat1)
    rows = b.select("borough", "a", "b", x0.alias("x0"), x1.alias("x1"))
    near = (F.abs(F.col("x0") - F.col("a")) < 5.0) & (F.abs(F.col("x1") - F.col("b")) < 5.0)
    return rows.select("borough", F.when(near, F.round("a", 1)).alias("x0"), F.when(near, F.round("b", 1)).alias("x1"))


# ---- feeds: written as GeoJSON lines by Spark, then read like landed files -------

def feed_path(spark, sf, name, df):
    root = f"{checkpoint_root(spark)}/feeds/{spark.sparkContext.applicationId}/{abs(hash(sf))}/{name}"
    if (spark.sparkContext.applicationId, sf, name) not in _WRITTEN:
        df.write.mode("overwrite").json(root)
        _WRITTEN.add((spark.sparkContext.applicationId, sf, name))
    return root


_WRITTEN: set = set()


def _degree_pairs(path):
    def one(p):
        lon, lat = to_degrees(p["x"], p["y"])
        return F.array(lon, lat)
    return F.transform(path, one)


def street_feed(spark, sf):
    s = streets(spark, sf)
    k = F.col("seq")
    props = F.struct(F.col("physical_id").cast("string").alias("physicalid"), F.upper("street_name").alias("full_street_name"),
                     F.col("borough").alias("boroughcode"), F.element_at(F.array(*map(F.lit, ("1", "6", "2", "10"))), (k % 4 + 1).cast("int")).alias("rw_type"),
                     F.round(F.col("street_width_m") / 0.3048, 3).cast("string").alias("streetwidth"))
    geometry = F.struct(F.lit("MultiLineString").alias("type"), F.array(_degree_pairs(F.col("path"))).alias("coordinates"))
    return feed_path(spark, sf, "streets", s.select(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))


ISLANDS = " OR ".join(f"(lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n})" for w, s, e, n in feeds.C.ISLAND_BOXES)
FEEDS = {**STREETS,
    "mids": (("streets",), """SELECT *, CASE dir WHEN 0 THEN x + 40 ELSE x + bend END AS mx, CASE dir WHEN 0 THEN y + bend ELSE y + 40 END AS my FROM streets"""),
    "mids_ll": (("mids", "lcc"), ll_sql("mids", "mx", "my")),
    "tree_ll": (("tree_points", "lcc"), ll_sql("tree_points")),
    "b_centre": (("buildings",), "SELECT *, (bx0 + bx1) / 2 AS cx, (by0 + by1) / 2 AS cy FROM buildings")}


@query("read_streets", compose(f"""
    SELECT physical_id::BIGINT AS physical_id, street_name, borough, round((off - 2) * 2, 3) AS street_width_m, round(x, 2) AS x, round(y, 2) AS y
    FROM (SELECT * REPLACE (CASE WHEN off = 6.0 THEN NULL WHEN off > 20 THEN 140 * 0.3048 / 2 + 2 ELSE off END AS off) FROM mids_ll)
    WHERE seq % 4 <> 2 AND NOT ({ISLANDS})""", "mids_ll", extra=FEEDS))
def read_streets(spark, sf):
    out = feeds.read_streets(spark, street_feed(spark, sf), "manhattan_brooklyn")
    return out.select("physical_id", "street_name", "borough", F.round("street_width_m", 3).alias("street_width_m"),
                      F.round(F.col("path")[0]["x"], 2).alias("x"), F.round(F.col("path")[0]["y"], 2).alias("y"))


@query("exclude_islands", compose(f"SELECT seq::BIGINT AS seq FROM mids_ll WHERE NOT ({ISLANDS})", "mids_ll", extra=FEEDS))
def exclude_islands(spark, sf):
    return feeds.exclude_islands(streets(spark, sf)).select("seq")


@query("title_case", "SELECT c_custkey::BIGINT AS c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment FROM customer")
def title_case(spark, sf):
    return city.read(spark, sf, "customer").select("c_custkey", feeds.title_case(F.col("c_mktsegment")).alias("segment"))


def building_feeds(spark, sf):
    b = city.buildings(spark, sf)
    k = F.col("building_id")
    props = F.struct(k.cast("string").alias("bin"), F.when(k % 50 == 0, F.lit(3.0)).otherwise(F.col("height_m") / 0.3048).alias("height_roof"),
                     F.when(k % 7 != 0, F.col("base_m") / 0.3048).alias("ground_elevation"), F.when(k % 11 == 0, "1001").otherwise("2100").alias("feature_code"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", _degree_pairs).alias("coordinates"))
    rows = b.select(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"), k.alias("_k"))
    return {"1": feed_path(spark, sf, "buildings1", rows.filter("_k % 2 = 0").drop("_k")), "3": feed_path(spark, sf, "buildings3", rows.filter("_k % 2 = 1").drop("_k"))}


@query("read_buildings", compose("""
    SELECT building_id::VARCHAR AS bin, CASE WHEN building_id % 2 = 0 THEN '1' ELSE '3' END AS borough, round(height_m, 3) AS height_m, round(base_m, 3) AS base_m,
           round(bx0, 2) AS x, round(by0, 2) AS y FROM buildings WHERE building_id % 11 <> 0 AND building_id % 50 <> 0""", "buildings"))
def read_buildings(spark, sf):
    out = feeds.read_buildings(spark, building_feeds(spark, sf), "manhattan_brooklyn")
    return out.select("bin", "borough", F.round("height_m", 3).alias("height_m"), F.round("base_m", 3).alias("base_m"),
                      F.round(F.col("rings")[0][0]["x"], 2).alias("x"), F.round(F.col("rings")[0][0]["y"], 2).alias("y"))


@query("read_trees", compose("""
    SELECT species, count(*)::BIGINT AS n, round(sum(least(raw_dbh * 2, 60) * 2.54), 3) AS dbh_sum, round(min(x_m), 2) AS x_min, round(max(y_m), 2) AS y_max
    FROM tree_ll WHERE tree_id % 9 <> 0 AND tree_id % 5 <> 4 AND lon BETWEEN -74.05 AND -73.833 AND lat BETWEEN 40.57 AND 40.883 GROUP BY 1""", "tree_ll", extra=FEEDS))
def read_trees(spark, sf):
    out = feeds.read_trees(spark, tree_feed(spark, sf), "manhattan_brooklyn")
    return out.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dbh_cm"), 3).alias("dbh_sum"),
                                      F.round(F.min("x_m"), 2).alias("x_min"), F.round(F.max("y_m"), 2).alias("y_max"))


def tree_feed(spark, sf):
    t = city.tree_points(spark, sf)
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    props = F.struct(lon.cast("string").alias("longitude"), lat.cast("string").alias("latitude"),
                     F.when(F.col("tree_id") % 5 == 4, "4").when(F.col("tree_id") % 2 == 0, "1").otherwise("3").alias("borocode"),
                     F.when(F.col("tree_id") % 9 == 0, "Dead").otherwise("Alive").alias("status"), (F.col("dbh_cm") * 2).cast("string").alias("tree_dbh"), F.col("species").alias("spc_latin"))
    return feed_path(spark, sf, "trees", t.select(F.lit("Feature").alias("type"), props.alias("properties")))


@query("read_amenities", compose("""
    SELECT kind::BIGINT AS kind, name, round(x_m, 2) AS x_m, round(y_m, 2) AS y_m FROM amenities_ll
    WHERE kind < 2 AND lon > -74.05 AND lon < -73.833 AND lat > 40.57 AND lat < 40.883""", "amenities_ll"))
def read_amenities(spark, sf):
    """Fountains as features, cooling sites as bare objects with lon and lat called x and y."""
    fountains, cooling = place_feeds(spark, sf)
    places = feeds.read_places(spark, fountains, 0).unionByName(feeds.read_places(spark, cooling, 1))
    return feeds.in_scope(places, "manhattan_brooklyn").select(F.col("kind").cast("long").alias("kind"), "name", F.round("x_m", 2).alias("x_m"), F.round("y_m", 2).alias("y_m"))


def place_feeds(spark, sf):
    a = city.amenities(spark, sf)
    fountains = a.filter("kind = 0").select(F.struct(F.col("name").alias("propertyna")).alias("properties"),
                                            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    cooling = a.filter("kind = 1").select(F.col("name").alias("site_name"), F.col("lon").cast("string").alias("x"), F.col("lat").cast("string").alias("y"))
    return feed_path(spark, sf, "fountains", fountains), feed_path(spark, sf, "cooling", cooling)


@query("filter_parks", """
    SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'Park' END AS label FROM orders
    WHERE o_orderkey % 5 IN (0, 1) AND o_orderkey % 7 <> 3 AND (o_orderkey % 2000) / 100.0 >= 0.25""")
def filter_parks(spark, sf):
    k = F.col("o_orderkey")
    classes = F.array(*map(F.lit, ("park", "Nature Area", "LOT", "MARKET", "")))
    rows = city.read(spark, sf, "orders").select(
        k, F.element_at(classes, (k % 5 + 1).cast("int")).alias("class"), F.when(k % 7 == 3, "Strip").otherwise("Garden").alias("typecategory"),
        F.format_string("%,.2f", (k % 2000) / 100.0).alias("acres"), F.lit("  ").alias("signname"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("name311"), F.lit(None).cast("string").alias("location"))
    return feeds.filter_parks(rows).select("o_orderkey", feeds.park_label("signname", "name311", "location").alias("label"))


@query("read_weather_hours", compose("""
    SELECT hour_s::BIGINT AS hour_s, air_temp_c, round(wind_speed_10m_ms, 6) AS wind_speed_10m_ms, 'feed' AS source FROM weather""", "weather"))
def read_weather_hours(spark, sf):
    """Hourly rows written as one payload of parallel arrays per day."""
    w = city.weather(spark, sf)
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("hour_s"), "America/New_York"), "yyyy-MM-dd'T'HH:mm")
    w = w.withColumn("t", local)
    names = {"temperature_2m": "air_temp_c", "relative_humidity_2m": "relative_humidity_pct", "wind_speed_10m": "kmh", "cloud_cover": "cloud_cover_pct",
             "direct_normal_irradiance": "direct_normal_wm2", "diffuse_radiation": "diffuse_wm2", "shortwave_radiation": "global_horizontal_wm2", "uv_index": "uv_index"}
    w = w.withColumn("kmh", F.col("wind_speed_10m_ms") * 3.6)
    hour = F.struct("hour_s", "t", *names.values())
    per = w.groupBy(F.substring("t", 1, 10).alias("day")).agg(F.array_sort(F.collect_list(hour)).alias("h"))
    hourly = F.struct(F.col("h.t").alias("time"), *[F.col(f"h.{c}").alias(n) for n, c in names.items()])
    path = feed_path(spark, sf, "weather", per.select(hourly.alias("hourly")))
    return feeds.read_weather_hours(spark, path).select("hour_s", "air_temp_c", F.round("wind_speed_10m_ms", 6).alias("wind_speed_10m_ms"), "source")


# ---- rasters ---------------------------------------------------------------------

RES = 10.0
RASTER = {
    "pixels": (("grid",), """
        SELECT row, col, 1 + min(l_quantity::BIGINT % 7) AS class FROM (
          SELECT (l_partkey * 3 + l_suppkey) % (8 * w) AS row, (l_orderkey * 13 + l_linenumber * 5) % (8 * w) AS col, l_quantity FROM lineitem, grid) GROUP BY 1, 2"""),
    "top": (("grid",), "SELECT (64000 + 80 * w)::DOUBLE AS y1 FROM grid"),
    "crown_px": (("trees", "grid"), """
        SELECT DISTINCT row, col FROM (
          SELECT (x_m - 300000) / 10 AS c, (64000 + 80 * w - y_m) / 10 AS r, crown_radius_m / 10 AS q, w,
                 unnest(range(floor((64000 + 80 * w - y_m) / 10)::BIGINT - 3, floor((64000 + 80 * w - y_m) / 10)::BIGINT + 4)) AS row FROM trees, grid),
          LATERAL (SELECT unnest(range(floor(c)::BIGINT - 3, floor(c)::BIGINT + 4)) AS col)
        WHERE pow(col + 0.5 - c, 2) + pow(row + 0.5 - r, 2) <= q * q AND row BETWEEN 0 AND 8 * w - 1 AND col BETWEEN 0 AND 8 * w - 1""")}


def side_of(spark, sf) -> int:
    return int(city._grid(spark, sf).first()["w"])


def pixels(spark, sf):
    li = city.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").crossJoin(F.broadcast(city._grid(spark, sf)))
    row, col = (F.col("l_partkey") * 3 + F.col("l_suppkey")) % (F.col("w") * 8), (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 5) % (F.col("w") * 8)
    return li.groupBy(row.alias("row"), col.alias("col")).agg((F.min(F.col("l_quantity").cast("long") % 7) + 1).alias("class"))


@query("landcover_lookup", compose("""
    SELECT sample_id::BIGINT AS sample_id, coalesce(class, 7)::BIGINT AS landcover_class, [0.18, 0.21, 0.20, 0.07, 0.15, 0.12, 0.25][coalesce(class, 7)]::DOUBLE AS ground_albedo
    FROM (SELECT *, floor((y1 - y_m) / 10)::BIGINT AS row, floor((x_m - 300000) / 10)::BIGINT AS col FROM samples, top) LEFT JOIN pixels USING (row, col)""", "samples", "pixels", "top", extra=RASTER))
def landcover_lookup(spark, sf):
    out = L.landcover_lookup(city.samples(spark, sf), pixels(spark, sf), city.X0, city.Y0 + 80.0 * side_of(spark, sf), RES)
    return out.select("sample_id", F.col("landcover_class").cast("long").alias("landcover_class"), "ground_albedo")


@query("canopy_mask", compose("""
    SELECT r AS row, c AS col FROM (SELECT r, c, floor((r + 0.5) * 20 / 10)::BIGINT AS row, floor((c + 0.5) * 20 / 10)::BIGINT AS col
      FROM (SELECT unnest(range(0, 4 * w)) AS r, w FROM grid), LATERAL (SELECT unnest(range(0, 4 * w)) AS c))
    JOIN pixels USING (row, col) WHERE class = 1""", "grid", "pixels", extra=RASTER))
def canopy_mask(spark, sf):
    size = 80.0 * side_of(spark, sf)
    scope = city._grid(spark, sf).select(F.lit(float(city.X0)).alias("mx0"), F.lit(float(city.Y0)).alias("my0"),
                                         F.lit(city.X0 + size).alias("mx1"), F.lit(city.Y0 + size).alias("my1"))
    return L.canopy_mask(scope, pixels(spark, sf), city.X0, city.Y0 + size, RES, 20.0)


def crowns_raster(spark, sf):
    w = side_of(spark, sf)
    return L.crown_pixels(city.trees(spark, sf), city.X0, city.Y0 + 80.0 * w, RES, 8 * w, 8 * w)


@query("crown_pixels", compose("SELECT row::BIGINT AS row, col::BIGINT AS col FROM crown_px", "crown_px", extra=RASTER))
def crown_pixels(spark, sf):
    return crowns_raster(spark, sf)


@query("canopy_accuracy", compose("""
    SELECT 'ok' AS status, round(b / greatest(1, k), 6) AS recall, round(b / greatest(1, m), 6) AS precision, m * 100.0::DOUBLE AS modelled_area_m2, k * 100.0::DOUBLE AS raster_area_m2
    FROM (SELECT (SELECT count(*) FROM crown_px) AS m, (SELECT count(*) FROM pixels WHERE class = 1) AS k,
                 (SELECT count(*) FROM crown_px JOIN pixels USING (row, col) WHERE class = 1) AS b)""", "crown_px", "pixels", extra=RASTER))
def canopy_accuracy(spark, sf):
    out = L.canopy_accuracy(crowns_raster(spark, sf), pixels(spark, sf).filter("class = 1").select("row", "col"), RES)
    return out.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


# ---- parks -------------------------------------------------------------------------

PARKS = {
    "parks": (("grid",), """
        SELECT s_suppkey AS park_id, (300000 + (s_suppkey * 7 % w) * 80 + 15)::DOUBLE AS x, (64000 + (s_suppkey * 5 % w) * 80 + 10)::DOUBLE AS y,
               (50 + s_suppkey % 4 * 20)::DOUBLE AS a, (60 + s_suppkey % 3 * 30)::DOUBLE AS b FROM supplier, grid"""),
    "outline": (("parks",), """
        SELECT *, CASE WHEN d < a THEN x + d WHEN d < a + b THEN x + a WHEN d < 2 * a + b THEN x + a - (d - a - b) ELSE x END AS px,
               CASE WHEN d < a THEN y WHEN d < a + b THEN y + d - a WHEN d < 2 * a + b THEN y + b ELSE y + b - (d - 2 * a - b) END AS py
        FROM (SELECT *, pos * (2 * (a + b)) / n AS d FROM (SELECT *, unnest(range(0, n)) AS pos FROM (SELECT *, greatest(4, floor(2 * (a + b) / 15))::BIGINT AS n FROM parks)))"""),
    "gates": (("outline", "edges"), """
        SELECT park_id, pos, any_value(px) AS px, any_value(py) AS py FROM (SELECT *, floor(px / 60) AS cx, floor(py / 60) AS cy FROM outline) o
        JOIN (SELECT *, unnest(range(floor((least(ax, bx) - 15) / 60)::BIGINT, floor((greatest(ax, bx) + 15) / 60)::BIGINT + 1)) AS cx,
                     floor((least(ay, yb) - 15) / 60)::BIGINT AS lo, floor((greatest(ay, yb) + 15) / 60)::BIGINT AS hi FROM edges) e ON o.cx = e.cx AND o.cy BETWEEN lo AND hi
        WHERE sqrt(pow(px - (ax + (bx - ax) * s(ax, ay, bx, yb, px, py)), 2) + pow(py - (ay + (yb - ay) * s(ax, ay, bx, yb, px, py)), 2)) <= 15 + 1e-6 GROUP BY 1, 2""")}
SHARE = "greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (yb - ay)) / (pow(bx - ax, 2) + pow(yb - ay, 2))))"
PARKS["gates"] = (PARKS["gates"][0], PARKS["gates"][1].replace("s(ax, ay, bx, yb, px, py)", SHARE))


def park_outlines(spark, sf):
    s, w = F.col("s_suppkey"), F.col("w")
    rows = city.read(spark, sf, "supplier").select("s_suppkey").crossJoin(F.broadcast(city._grid(spark, sf)))
    x = F.lit(city.X0 + 15) + (s * 7 % w) * 80
    y = F.lit(city.Y0 + 10) + (s * 5 % w) * 80
    a, b = F.lit(50) + s % 4 * 20, F.lit(60) + s % 3 * 30
    ring = G.path_of((x, y), (x + a, y), (x + a, y + b), (x, y + b), (x, y))
    return rows.select(s.alias("park_id"), F.lit(0).alias("part"), F.array(ring).alias("rings"))


@query("park_boundary_points", compose("SELECT park_id::BIGINT AS park_id, pos::BIGINT AS pos, round(px, 4) AS x_m, round(py, 4) AS y_m FROM outline", "outline", extra=PARKS))
def park_boundary_points(spark, sf):
    return P.boundary_points(park_outlines(spark, sf)).select("park_id", F.col("pos").cast("long").alias("pos"), F.round("x_m", 4).alias("x_m"), F.round("y_m", 4).alias("y_m"))


def entrances(spark, sf):
    return P.park_entrances(P.boundary_points(park_outlines(spark, sf)), city.edges(spark, sf))


@query("park_entrances", compose("SELECT park_id::BIGINT AS park_id, pos::BIGINT AS pos, round(px, 4) AS x_m, round(py, 4) AS y_m FROM gates", "gates", extra=PARKS))
def park_entrances(spark, sf):
    return entrances(spark, sf).select("park_id", F.col("pos").cast("long").alias("pos"), F.round("x_m", 4).alias("x_m"), F.round("y_m", 4).alias("y_m"))


PARKS |= {
    "in_order": (("gates",), "SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY pos) AS i FROM gates"),
    "thin": (("in_order",), """
        SELECT DISTINCT park_id, 0::BIGINT AS i, 0::BIGINT AS pos, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, false AS took FROM in_order
        UNION ALL SELECT park_id, i, pos, px, py, CASE WHEN free THEN list_append(kept, struct_pack(x := px, y := py)) ELSE kept END, free FROM (
          SELECT o.park_id, o.i, o.pos, o.px, o.py, t.kept, len(list_filter(t.kept, lambda k: sqrt(pow(k.x - o.px, 2) + pow(k.y - o.py, 2)) < 80 - 1e-6)) = 0 AS free
          FROM thin t JOIN in_order o ON o.park_id = t.park_id AND o.i = t.i + 1)""")}


@query("thin_gates", compose("""
    SELECT park_id::BIGINT AS park_id, pos::BIGINT AS pos, round(px, 4) AS x_m, round(py, 4) AS y_m FROM thin WHERE took""", "thin", extra=PARKS).replace("WITH ", "WITH RECURSIVE ", 1))
def thin_gates(spark, sf):
    return P.thin_gates(entrances(spark, sf)).select("park_id", F.col("pos").cast("long").alias("pos"), F.round("x_m", 4).alias("x_m"), F.round("y_m", 4).alias("y_m"))


@query("amenity_union", compose("""
    SELECT kind::BIGINT AS kind, count(*)::BIGINT AS n FROM (SELECT kind FROM amenities WHERE kind < 2 UNION ALL SELECT 2 FROM gates) GROUP BY 1""", "amenities", "gates", extra=PARKS))
def amenity_union(spark, sf):
    places = city.amenities(spark, sf).filter("kind < 2").select(F.col("kind").cast("long").alias("kind"))
    gates = entrances(spark, sf).select(F.lit(2).cast("long").alias("kind"))
    return places.unionByName(gates).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- beams at one instant -----------------------------------------------------------

BEAM = {
    "noon": ((), f"SELECT {NOON_S} AS epoch_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon"),
    "noon_sun": (("noon",), sun_sql("noon")),
    "ray": (("noon_sun",), "SELECT sin(radians(azimuth_deg)) AS dx, cos(radians(azimuth_deg)) AS dy, elevation_deg AS el, azimuth_deg AS az FROM noon_sun"),
    "beam_walls": (("wall_near", "ray"), """
        SELECT * FROM (
          SELECT sample_id, building_id, height_m, el, ((ax - x_m) * (yb - ay) - (ay - y_m) * (bx - ax)) / (dx * (yb - ay) - dy * (bx - ax)) AS dist,
                 ((ax - x_m) * dy - (ay - y_m) * dx) / (dx * (yb - ay) - dy * (bx - ax)) AS share,
                 (bx - ax) * (y_m - ay) - (yb - ay) * (x_m - ax) < 0 AS faces
          FROM wall_near, ray WHERE dx * (yb - ay) - dy * (bx - ax) <> 0)
        WHERE dist >= 0 AND dist <= 400 AND share >= -1e-9 AND share <= 1 + 1e-9"""),
    "roofs": (("beam_walls",), """
        SELECT sample_id, building_id, any_value(height_m) AS height_m, any_value(el) AS el, degrees(atan((any_value(height_m) - 1.1) / min(dist))) AS angle
        FROM beam_walls GROUP BY 1, 2 HAVING arg_min(faces, (dist, NOT faces)) AND min(dist) > 0.01"""),
    "beam_crowns": (("crown_near", "ray"), """
        SELECT sample_id, species, tau FROM (
          SELECT *, (tx - x_m) * dx + (ty - y_m) * dy AS along, abs((tx - x_m) * dy - (ty - y_m) * dx) AS off FROM crown_near, ray)
        WHERE off <= r AND along > 0 AND along <= 400 AND crown_base_m <= 1.1 + along * tan(radians(el)) AND 1.1 + along * tan(radians(el)) <= crown_top_m"""),
    "through": (("samples", "beam_crowns"), """
        SELECT s.sample_id, coalesce(product(tau), 1.0) AS t FROM samples s LEFT JOIN beam_crowns b ON b.sample_id = s.sample_id GROUP BY 1""")}


def noon_points(spark, sf):
    """Every sample with the sun of one instant, which is one row."""
    one = with_sun(spark.range(1).select(F.lit(NOON_S).alias("epoch_s"), F.lit(city.SITE_LAT).alias("lat"), F.lit(city.SITE_LON).alias("lon")))
    sun = one.select("azimuth_deg", "elevation_deg")
    return stage(spark, sf, "noon", lambda: city.samples(spark, sf).select("sample_id", "x_m", "y_m").crossJoin(F.broadcast(sun)))


@query("canopy_transmittance", compose("SELECT sample_id::BIGINT AS sample_id, round(t, 6) AS transmittance FROM through", "through", extra=BEAM))
def canopy_transmittance(spark, sf):
    return E.canopy_transmittance(noon_points(spark, sf), city.trees(spark, sf)).select("sample_id", F.round("transmittance", 6).alias("transmittance"))


@query("exact_f_sun", compose("""
    SELECT sample_id::BIGINT AS sample_id, round(CASE WHEN sample_id IN (SELECT sample_id FROM inside) OR sample_id IN (
      SELECT sample_id FROM beam_walls WHERE dist <= 0.01 OR degrees(atan((height_m - 1.1) / dist)) > el) THEN 0 ELSE t END, 6) AS f_sun
    FROM through""", "through", "beam_walls", "inside", extra=BEAM))
def exact_f_sun(spark, sf):
    return E.exact_f_sun(noon_points(spark, sf), city.buildings(spark, sf), city.trees(spark, sf)).select("sample_id", F.round("f_sun", 6).alias("f_sun"))


@query("blocking_building", compose("""
    SELECT sample_id::BIGINT AS sample_id, arg_max(building_id, (angle, -building_id))::BIGINT AS building_id FROM roofs WHERE angle > el GROUP BY 1""", "roofs", extra=BEAM))
def blocking_building(spark, sf):
    return E.blocking_building(noon_points(spark, sf), city.buildings(spark, sf)).select("sample_id", "building_id")


@query("dominant_species", compose("""
    SELECT sample_id::BIGINT AS sample_id, sum(n)::BIGINT AS n_crowns, arg_min(common, (-n, common)) FILTER (WHERE common IS NOT NULL) AS common_name FROM (
      SELECT sample_id, CASE split_part(species, ' ', 1) WHEN 'Quercus' THEN 'oak' WHEN 'Gleditsia' THEN 'honey locust' WHEN 'Ulmus' THEN 'elm'
        WHEN 'Acer' THEN 'maple' WHEN 'Betula' THEN 'birch' END AS common, count(*) AS n FROM beam_crowns GROUP BY 1, 2) GROUP BY 1""", "beam_crowns", extra=BEAM))
def dominant_species(spark, sf):
    return E.dominant_species(noon_points(spark, sf), city.trees(spark, sf))


# ---- plantings -------------------------------------------------------------------------

PLANT = {
    "planted": (("corners",), """
        SELECT c_custkey AS request_id, c_custkey, (300000 + 80 * col + 13)::DOUBLE AS px, (64000 + 80 * row + 11)::DOUBLE AS py,
               greatest(0.8, 0.55 * pow(25.0, 0.70)) AS r FROM corners JOIN customer ON c_custkey = k"""),
    "hit": (("samples", "planted"), """
        SELECT DISTINCT sample_id FROM samples JOIN planted ON abs(x_m - px) <= 410 AND abs(y_m - py) <= 410 AND sqrt(pow(x_m - px, 2) + pow(y_m - py, 2)) <= 400 + r""")}


def planted(spark, sf):
    """Every customer gets a tree at the corner."""
    c = city.corners(spark, sf)
    rows = c.select(F.col("k").cast("long").alias("request_id"), (F.col("k") + 10_000_000).alias("tree_id"), (F.lit(city.X0 + 13) + F.col("col") * 80).cast("double").alias("x_m"),
                    (F.lit(city.Y0 + 11) + F.col("row") * 80).cast("double").alias("y_m"), F.lit("Tilia cordata").alias("species"), F.lit(25.0).alias("dbh_cm"))
    return PL.plant_crowns(rows)


@query("affected_samples", compose("SELECT sample_id::BIGINT AS sample_id FROM hit", "hit", extra=PLANT))
def affected_samples(spark, sf):
    return PL.affected_samples(city.samples(spark, sf).select("sample_id", "x_m", "y_m"), planted(spark, sf)).select("sample_id")


@query("plant_append", compose("SELECT 2::BIGINT AS scene_version, (SELECT count(*) FROM trees) + (SELECT count(*) FROM planted) AS n_trees", "trees", "planted", extra=PLANT))
def plant_append(spark, sf):
    return PL.plant_append(city.trees(spark, sf), planted(spark, sf), 1).groupBy(F.col("scene_version").cast("long").alias("scene_version")).agg(F.count(F.lit(1)).alias("n_trees"))


# ten customers make one request; every 37th tree is too thick, every 101st lies far outside
ASKED = {
    "asked": (("corners", "lcc"), ll_sql("""(SELECT k AS tree_no, k // 10 AS request_id, CASE WHEN k % 37 = 0 THEN 130.0 ELSE 25.0 END AS dbh_cm,
               (300000 + 80 * col + 13 + CASE WHEN k % 101 = 0 THEN 60000 ELSE 0 END)::DOUBLE AS x_m, (64000 + 80 * row + 11)::DOUBLE AS y_m FROM corners)""")),
    "judged": (("asked", "nodes_ll"), """
        SELECT *, CASE WHEN NOT (lon BETWEEN w AND e AND lat BETWEEN s AND n) THEN 'outside the plant area' WHEN NOT dbh_cm BETWEEN 1 AND 100 THEN 'diameter outside 1..100 cm' END AS own
        FROM asked, (SELECT min(lon) - 0.01 AS w, max(lon) + 0.01 AS e, min(lat) - 0.01 AS s, max(lat) + 0.01 AS n FROM nodes_ll)""")}


def asked(spark, sf):
    """Requests of ten customers each, with some trees that cannot be planted."""
    k = F.col("k")
    rows = city.corners(spark, sf).select(
        k.cast("long").alias("tree_no"), F.floor(k / 10).cast("long").alias("request_id"), F.lit("Tilia cordata").alias("species"), F.when(k % 37 == 0, 130.0).otherwise(25.0).alias("dbh_cm"),
        (F.lit(city.X0 + 13) + F.col("col") * 80 + F.when(k % 101 == 0, 60000).otherwise(0)).cast("double").alias("x_m"), (F.lit(city.Y0 + 11) + F.col("row") * 80).cast("double").alias("y_m"))
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    return rows.withColumns({"lon": lon, "lat": lat})


@query("judged_plantings", compose("""
    SELECT tree_no::BIGINT AS tree_no, request_id::BIGINT AS request_id, coalesce(own, 'refused with its request: ' || min(own) OVER (PARTITION BY request_id)) AS reject FROM judged""", "judged", extra=ASKED))
def judged_plantings(spark, sf):
    return PL.judged_plantings(asked(spark, sf), city.nodes(spark, sf)).select("tree_no", "request_id", "reject")


@query("accepted_plantings", compose("""
    SELECT request_id::BIGINT AS request_id, count(*)::BIGINT AS n FROM judged GROUP BY 1 HAVING count(own) = 0""", "judged", extra=ASKED))
def accepted_plantings(spark, sf):
    return PL.accepted_plantings(asked(spark, sf), city.nodes(spark, sf)).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


def scene_with(crowns: str, *needs: str) -> dict:
    """The canopy rules over the trees and the crowns of a CTE; names end in 2."""
    chain = {}
    for name in ("tree_cells", "crown_near", "crown_hits", "canopy_bins", "canopy"):
        deps, sql = CTES[name]
        for old in ("trees", "tree_cells", "crown_near", "crown_hits", "canopy_bins"):
            deps = tuple(f"{d}2" if d == old else d for d in deps)
            sql = sql.replace(f"FROM {old} ", f"FROM {old}2 ").replace(f"JOIN {old} ", f"JOIN {old}2 ").replace(f"FROM {old})", f"FROM {old}2)").replace(f"FROM {old}\n", f"FROM {old}2\n")
        chain[f"{name}2"] = (deps, sql)
    top = "greatest(3.0, 1.35 * pow(25.0, 0.62))"
    chain["trees2"] = (("trees", *needs), f"""
        SELECT tree_id, x_m, y_m, species, crown_radius_m, crown_base_m, crown_top_m, tau FROM trees
        UNION ALL SELECT -1 - k, px, py, 'Tilia cordata', greatest(0.8, 0.55 * pow(25.0, 0.70)), greatest(2.0, {top} * 0.35), greatest({top}, greatest(2.0, {top} * 0.35) + 1.0), 0.08
        FROM ({crowns})""")
    return chain


MOVED = """SELECT n.sample_id::BIGINT AS sample_id, array_to_string(n.tau_q, ',') AS tau_q FROM canopy2 n JOIN canopy o ON o.sample_id = n.sample_id
    WHERE n.canopy <> o.canopy OR n.tau_q <> o.tau_q"""
REPLANTED = {**PLANT, **scene_with("SELECT c_custkey AS k, px, py FROM planted", "planted")}
STREAMED = {**ASKED, **scene_with("SELECT tree_no AS k, x_m AS px, y_m AS py FROM judged WHERE request_id NOT IN (SELECT request_id FROM judged WHERE own IS NOT NULL)", "judged")}


def moved_from(before, after):
    now = after.select("sample_id", F.col("canopy").alias("c"), F.col("tau_q").alias("t"))
    both = before.join(now, "sample_id").filter((F.col("canopy") != F.col("c")) | (F.col("tau_q") != F.col("t")))
    return both.select("sample_id", F.array_join(F.col("t").cast("array<string>"), ",").alias("tau_q"))


@query("plantings_stream", compose(MOVED, "canopy", "canopy2", extra=STREAMED))
def plantings_stream(spark, sf):
    """Requests as files in four micro-batches: the samples whose canopy arrays the stream has changed."""
    names = [f.split()[0] for f in ST.REQUEST_SCHEMA.split(", ")]
    path = feed_path(spark, sf, "plantings", asked(spark, sf).select(*names).repartition(4, "request_id"))
    out = f"{checkpoint_root(spark)}/plantings/{uuid.uuid4().hex}"
    requests = ST.read_requests(spark, path, files_per_batch=1)
    before = horizon_table(spark, sf)
    # every batch reads them several times
    nodes, samples, trees = (stage(spark, sf, f"planted_{name}", lambda: rows.select(*columns)) for name, rows, columns in (
        ("nodes", city.nodes(spark, sf), ["lon", "lat"]), ("samples", city.samples(spark, sf), ["sample_id", "x_m", "y_m"]), ("trees", city.trees(spark, sf), ST.SCENE)))
    ST.run_plantings(spark, requests, nodes, samples, trees, out, f"{out}/checkpoint").awaitTermination()
    return moved_from(before, ST.newest_horizon(before, out))


def replanted(spark, sf):
    return stage(spark, sf, "replanted", lambda: PL.replanted_horizon(
        city.samples(spark, sf), horizon_table(spark, sf), city.trees(spark, sf), planted(spark, sf)))


@query("replanted_horizon", compose(MOVED, "canopy", "canopy2", extra=REPLANTED))
def replanted_horizon(spark, sf):
    """Samples whose canopy arrays the plantings changed."""
    return moved_from(horizon_table(spark, sf), replanted(spark, sf))


@query("planting_impact")
def planting_impact(spark, sf):
    from ..operators import exposure as X
    from .thermal_queries import cost_of, panel_keys
    keys = panel_keys(spark, sf)
    # the horizon table comes first, for both
    after = shaded_samples(city.samples(spark, sf), replanted(spark, sf))
    moments = X.instants(keys, city.weather(spark, sf), city.SITE_LAT, city.SITE_LON)
    change = PL.cost_change(cost_of(keys, spark, sf), X.edge_cost(keys, city.edges(spark, sf), after, moments))
    return change.select("edge_id", "minute", *[F.round(c, 4).alias(c) for c in ("before_c", "after_c", "cooling_c")])


@query("service_area", compose("""
    SELECT amenity_id::BIGINT AS amenity_id, lon BETWEEN w AND e AND lat BETWEEN s AND n AS covered FROM amenities_ll,
      (SELECT min(lon) - 0.005 AS w, max(lon) + 0.005 AS e, min(lat) - 0.005 AS s, max(lat) + 0.005 AS n FROM nodes_ll)""", "amenities_ll", "nodes_ll"))
def service_area(spark, sf):
    return PL.service_area(city.amenities(spark, sf), city.nodes(spark, sf)).select("amenity_id", "covered")


@query("nearest_node", compose("""
    SELECT amenity_id::BIGINT AS amenity_id, arg_min(node_id, (d, node_id))::BIGINT AS node_id FROM (
      SELECT amenity_id, node_id, round(sqrt(pow(a.lon - n.lon, 2) + pow(a.lat - n.lat, 2)), 12) AS d FROM amenities_ll a
      JOIN nodes_ll n ON abs(a.lon - n.lon) < 0.004 AND abs(a.lat - n.lat) < 0.004) GROUP BY 1""", "amenities_ll", "nodes_ll"))
def nearest_node(spark, sf):
    """By degrees, not metres."""
    a, n = city.amenities(spark, sf), city.nodes(spark, sf)
    return E.nearest_point(a, "amenity_id", "lon", "lat", n.select("node_id", F.col("lon").alias("nx"), F.col("lat").alias("ny")), "node_id", "nx", "ny", 0.001).select("amenity_id", "node_id")


# ---- map views ---------------------------------------------------------------------------

VIEWS = {
    "views": (("grid",), """
        SELECT s_suppkey AS box_id, (300000 + s_suppkey * 131 % (80 * w))::DOUBLE AS x0, (64000 + s_suppkey * 71 % (80 * w))::DOUBLE AS y0,
               (300000 + s_suppkey * 131 % (80 * w) + 700)::DOUBLE AS x1, (64000 + s_suppkey * 71 % (80 * w) + 500)::DOUBLE AS y1 FROM supplier, grid"""),
    "seen": (("views", "buildings"), "SELECT box_id, building_id, height_m FROM views JOIN buildings ON bx0 <= x1 AND bx1 >= x0 AND by0 <= y1 AND by1 >= y0")}


def views(spark, sf):
    s, side = F.col("s_suppkey"), F.col("w") * 80
    rows = city.read(spark, sf, "supplier").select("s_suppkey").crossJoin(F.broadcast(city._grid(spark, sf)))
    x, y = (F.lit(city.X0) + s * 131 % side).cast("double"), (F.lit(city.Y0) + s * 71 % side).cast("double")
    return rows.select(s.alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 700).alias("x1"), (y + 500).alias("y1"))


def seen(spark, sf):
    from ..operators.scene import footprint_bounds
    return M.buildings_in_view(footprint_bounds(city.buildings(spark, sf)), views(spark, sf))


@query("buildings_in_view", compose("SELECT box_id::BIGINT AS box_id, building_id::BIGINT AS building_id, height_m FROM seen", "seen", extra=VIEWS))
def buildings_in_view(spark, sf):
    return seen(spark, sf)


@query("tallest_in_view", compose("""
    SELECT box_id::BIGINT AS box_id, building_id::BIGINT AS building_id, i::BIGINT AS place, c > 20 AS truncated FROM (
      SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY height_m DESC, building_id) AS i, count(*) OVER (PARTITION BY box_id) AS c FROM seen) WHERE i <= 20""", "seen", extra=VIEWS))
def tallest_in_view(spark, sf):
    return M.tallest_in_view(seen(spark, sf), 20).select("box_id", "building_id", F.col("place").cast("long").alias("place"), "truncated")


@query("view_complete_or_none", compose("""
    SELECT box_id::BIGINT AS box_id, building_id::BIGINT AS building_id, count(*) OVER (PARTITION BY box_id) > 60 AS truncated FROM seen""", "seen", extra=VIEWS))
def view_complete_or_none(spark, sf):
    return M.view_complete_or_none(seen(spark, sf), 60).select("box_id", "building_id", "truncated")


@query("building_tiles")
def building_tiles(spark, sf):
    return M.building_tiles(M.geographic_footprints(city.buildings(spark, sf)), limit=40)


@query("dedupe_tiles", "SELECT p_partkey::BIGINT AS building_id FROM part")
def dedupe_tiles(spark, sf):
    return M.dedupe_tiles(building_tiles(spark, sf))


@query("footprint_export", compose("""
    SELECT building_id::BIGINT AS building_id, height_m, base_m, 5::BIGINT AS n_points, (lon * 1e6)::BIGINT AS first_lon, (lat * 1e6)::BIGINT AS first_lat FROM corner_ll""", "corner_ll",
    extra={"corner_ll": (("buildings", "lcc"), ll_sql("buildings", "bx0", "by0"))}))
def footprint_export(spark, sf):
    out = M.footprint_export(city.buildings(spark, sf))
    return out.select("building_id", F.col("height_m").cast("double").alias("height_m"), F.col("base_m").cast("double").alias("base_m"), F.col("n_points").cast("long").alias("n_points"),
                      F.col("lon_lat")[0].cast("long").alias("first_lon"), F.col("lon_lat")[1].cast("long").alias("first_lat"))


@query("shadow_polygons")
def shadow_polygons(spark, sf):
    suns = with_sun(spark.range(9, 17).select((F.lit(city.DAY_START_S) + F.col("id") * 3600).alias("epoch_s"), F.lit(city.SITE_LAT).alias("lat"), F.lit(city.SITE_LON).alias("lon")))
    out = M.shadow_polygons(M.geographic_footprints(city.buildings(spark, sf)), suns, city.SITE_LAT)
    return out.select("epoch_s", "building_id", F.round("reach_m", 3).alias("reach_m"), F.size("shadow").alias("n_points"))


@query("amenities_in_view", compose("""
    SELECT box_id::BIGINT AS box_id, amenity_id::BIGINT AS amenity_id FROM amenities_ll, (
      SELECT node_id AS box_id, lon - 0.001 AS w, lat - 0.001 AS s, lon + 0.001 AS e, lat + 0.001 AS n FROM nodes_ll)
    WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n""", "amenities_ll", "nodes_ll"))
def amenities_in_view(spark, sf):
    boxes = city.nodes(spark, sf).select(F.col("node_id").alias("box_id"), (F.col("lon") - 0.001).alias("west"), (F.col("lat") - 0.001).alias("south"),
                                         (F.col("lon") + 0.001).alias("east"), (F.col("lat") + 0.001).alias("north"))
    return WP.amenities_in_view(city.amenities(spark, sf), boxes).select("box_id", "amenity_id")


@query("validate_bbox", """
    SELECT o_orderkey::BIGINT AS o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'bbox must be ordered west,south,east,north'
      WHEN 2 THEN 'bbox must be four comma-separated numbers: west,south,east,north' WHEN 3 THEN 'bbox values must be finite' END AS reject FROM orders""")
def validate_bbox(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat_ws(",", k, k, k + 1, k + 1)).when(k % 4 == 1, F.concat_ws(",", k + 1, k, k, k)).when(
        k % 4 == 2, F.concat_ws(",", k, F.lit("x"), k, k)).otherwise(F.concat_ws(",", k, F.lit("NaN"), k, k))
    return M.validate_bbox(city.read(spark, sf, "orders").select(k, text.alias("bbox"))).select("o_orderkey", "reject")


@query("place_filter", """
    SELECT r_regionkey::BIGINT AS query_id, place_id::BIGINT AS place_id FROM (
      SELECT r_regionkey, p_partkey AS place_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY p_partkey) AS i FROM part, region
      WHERE list_bool_and(list_transform(string_split(lower(['red', 'RING', 'blue w', 'g e', 'small'][(r_regionkey % 5 + 1)::INTEGER]), ' '), lambda w: contains(lower(p_name), w)))) WHERE i <= 5""")
def place_filter(spark, sf):
    texts = F.array(*map(F.lit, ("red", "RING", "blue w", "g e", "small")))
    asked = city.read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.element_at(texts, (F.col("r_regionkey") % 5 + 1).cast("int")).alias("q"))
    places = city.read(spark, sf, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("label"))
    return M.place_filter(places, asked).select("query_id", "place_id")
