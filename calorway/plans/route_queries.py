"""Walked routes: one fixed seven-leg walk per corner, and what is told about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.solar import with_sun
from ..operators import daylight as D
from ..operators import evidence as E
from ..operators import exposure as X
from ..operators import routes as R
from ..operators import search as S
from ..operators import waypoints as WP
from ..operators import weather as WX
from . import derived_city as city
from .oracle import compose
from .registry import query, stage
from .thermal_queries import EXTRA, cost_of, hours_for, panel_sql, shaded, sun_sql

KEYS = ["route_id"]
# per leg: edge number, node entered from, node reached, as multiples of n, k, w and a constant
LEGS = (
    ("2 * k", "2 * k", "2 * k + 2"),
    ("2 * k + 2", "2 * k + 2", "2 * k + 4"),
    ("4 * n + k + 2", "2 * k + 4", "2 * k + 5"),
    ("2 * n + 2 * k + 5", "2 * k + 5", "2 * k + 2 * w + 5"),
    ("2 * k + 2 * w + 3", "2 * k + 2 * w + 5", "2 * k + 2 * w + 3"),
    ("4 * n + k + w + 1", "2 * k + 2 * w + 3", "2 * k + 2 * w + 2"),
    ("2 * k + 2 * w", "2 * k + 2 * w + 2", "2 * k + 2 * w"),
)
WALKABLE = "col + 2 < w AND row <> w DIV 2 - 1 AND k + 2 + w < n"
DEPART = f"{city.DAY_START_S} + 46800 + (k % 4) * 900"

ROUTES = {
    **EXTRA,
    "legs0": (("corners",), " UNION ALL ".join(
        f"SELECT k AS route_id, {i} AS seq, {e} AS edge_id, {a} AS from_node, {b} AS to_node, {DEPART} AS depart_s FROM corners WHERE {WALKABLE.replace('DIV', '//')}"
        for i, (e, a, b) in enumerate(LEGS))),
    "legs": (("legs0", "edges"), """
        SELECT l.*, e.kind, e.side, e.street_name, e.length_m, e.bearing_deg, e.u, e.length_m / 1.35 + 20.0 * e.kind AS duration_s
        FROM legs0 l JOIN edges e USING (edge_id)"""),
    "start_hours": (("legs", "weather"), """
        SELECT depart_s, arg_min(hour_s, abs(hour_s - depart_s) * 2 + CASE WHEN hour_s > depart_s THEN 1 ELSE 0 END) AS hour_s
        FROM (SELECT DISTINCT depart_s FROM legs), weather GROUP BY 1"""),
    "clock": (("legs", "start_hours"), """
        SELECT *, floor(enter_s / 60)::BIGINT AS minute, enter_s + duration_s AS exit_s FROM (
          SELECT legs.*, hour_s, depart_s + coalesce(sum(duration_s) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS enter_s
          FROM legs JOIN start_hours USING (depart_s))"""),
    "leg_keys": (("clock",), f"""
        SELECT DISTINCT edge_id, minute, hour_s, minute * 60 AS epoch_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon FROM clock"""),
    "leg_sun": (("leg_keys",), sun_sql("leg_keys")),
    **panel_sql("leg_sun"),
    "walked": (("clock", "cost"), "SELECT c.*, k.* EXCLUDE (edge_id, minute, hour_s, duration_s) FROM clock c JOIN cost k USING (edge_id, minute, hour_s)"),
    "told": (("walked",), """
        SELECT *, last_value(CASE WHEN kind = 0 THEN street_name END IGNORE NULLS) OVER w AS p_street,
               last_value(CASE WHEN kind = 0 THEN side END IGNORE NULLS) OVER w AS p_side,
               last_value(CASE WHEN kind = 0 THEN mean_feels_like_c END IGNORE NULLS) OVER w AS p_feels,
               ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][
                 floor(((bearing_deg + CASE side WHEN 0 THEN -90 ELSE 90 END + 360) % 360 + 22.5) / 45)::INTEGER % 8 + 1] || ' side' AS named
        FROM walked WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "cards": (("told",), """
        SELECT route_id, seq, 'start' AS type, 'Head off along the ' || named || ' of ' || street_name AS text, from_node AS node_id, 0 AS rank, NULL AS delta FROM told WHERE seq = 0
        UNION ALL SELECT route_id, seq, CASE WHEN p_street = street_name THEN 'cross' ELSE 'turn' END,
          CASE WHEN p_street = street_name THEN 'Cross to the ' ELSE 'Turn onto the ' END || named || ' of ' || street_name, from_node, 1, p_feels - mean_feels_like_c
        FROM told WHERE kind = 0 AND p_street IS NOT NULL AND (p_street <> street_name OR p_side <> side)
        UNION ALL SELECT route_id, seq, 'arrive', 'Arrive', to_node, 2, NULL FROM told WHERE seq = 6"""),
}


def plain_legs(spark, sf):
    c = city.corners(spark, sf).filter(WALKABLE)
    entries = F.posexplode(F.array(*[F.struct(
        F.expr(e).alias("edge_id"), F.expr(a).alias("from_node"), F.expr(b).alias("to_node")) for e, a, b in LEGS])).alias("seq", "leg")
    rows = c.select(F.col("k").alias("route_id"), F.expr(DEPART).cast("long").alias("depart_s"), entries).select("route_id", "depart_s", "seq", "leg.*")
    e = city.edges(spark, sf).withColumn("duration_s", X.walk_duration(F.col("length_m"), F.col("kind")))
    return rows.join(e.drop("path", "width_m"), "edge_id")


def clocked(spark, sf):
    timed = hours_for(plain_legs(spark, sf).withColumn("at_s", F.col("depart_s")), spark, sf).drop("at_s")
    return stage(spark, sf, "clocked", lambda: R.leg_clock(timed, KEYS))


def walked(spark, sf):
    def build():
        legs = clocked(spark, sf)
        return R.with_costs(legs, cost_of(legs.select("edge_id", "minute", "hour_s"), spark, sf))
    return stage(spark, sf, "walked", build)


def cards(spark, sf):
    legs = walked(spark, sf).withColumn("feels_c", F.col("mean_feels_like_c")).withColumn("f_sun", F.col("mean_f_sun"))
    return stage(spark, sf, "cards", lambda: R.turn_cards(legs, KEYS))


@query("leg_clock", compose("""
    SELECT route_id::BIGINT AS route_id, seq::BIGINT AS seq, edge_id::BIGINT AS edge_id, round(enter_s - depart_s, 4) AS enter_after_s,
           round(exit_s - depart_s, 4) AS exit_after_s, minute::BIGINT AS minute, hour_s::BIGINT AS hour_s FROM clock""", "clock", extra=ROUTES))
def leg_clock(spark, sf):
    return clocked(spark, sf).select(
        "route_id", F.col("seq").cast("long").alias("seq"), "edge_id", F.round(F.col("enter_s") - F.col("depart_s"), 4).alias("enter_after_s"),
        F.round(F.col("exit_s") - F.col("depart_s"), 4).alias("exit_after_s"), "minute", "hour_s")


@query("route_summary", compose("""
    SELECT route_id::BIGINT AS route_id, round(sum(duration_s), 4) AS duration_s, round(sum(length_m), 4) AS distance_m,
           round(sum(mean_feels_like_c * length_m) / sum(length_m), 4) AS mean_c, round(max(mean_feels_like_c), 4) AS max_c,
           round(quantile_cont(mean_feels_like_c, 0.9), 4) AS p90_c, round(least(1, sum(mean_f_sun * length_m) / sum(length_m)), 5) AS sun_fraction,
           round(least(1, sum(mean_svf * length_m) / sum(length_m)), 5) AS mean_svf,
           round(least(1, sum(mean_canopy_fraction * length_m) / sum(length_m)), 5) AS canopy_fraction FROM walked GROUP BY 1""", "walked", extra=ROUTES))
def route_summary(spark, sf):
    out = R.route_summary(walked(spark, sf), KEYS)
    return out.select("route_id", *[F.round(c, 4).alias(c) for c in ("duration_s", "distance_m", "mean_c", "max_c", "p90_c")],
                      *[F.round(c, 5).alias(c) for c in ("sun_fraction", "mean_svf", "canopy_fraction")])


@query("turn_instructions", compose("""
    SELECT route_id::BIGINT AS route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq, rank)::BIGINT AS card_no, type, text,
           node_id::BIGINT AS node_id FROM cards""", "cards", extra=ROUTES))
def turn_instructions(spark, sf):
    return R.card_numbers(cards(spark, sf), KEYS).select("route_id", F.col("card_no").cast("long").alias("card_no"), "type", "text", "node_id")


@query("side_changes", compose("""
    SELECT route_id::BIGINT AS route_id, count_if(type = 'cross')::BIGINT AS side_changes FROM cards GROUP BY 1""", "cards", extra=ROUTES))
def side_changes(spark, sf):
    return R.side_changes(cards(spark, sf), KEYS)


@query("turn_delta", compose("""
    SELECT route_id::BIGINT AS route_id, seq::BIGINT AS seq, CASE WHEN abs(round_even(delta, 1)) >= 0.3 THEN round_even(delta, 1) END AS delta_c
    FROM cards WHERE rank = 1 AND abs(round_even(delta, 1)) >= 0.3""", "cards", extra=ROUTES))
def turn_delta(spark, sf):
    out = R.turn_why(cards(spark, sf)).filter("delta_c IS NOT NULL")
    return out.select("route_id", F.col("seq").cast("long").alias("seq"), "delta_c")


def asks(spark, sf):
    """Cross and turn cards as questions about the leg entered and the leg left."""
    rows = cards(spark, sf).filter("rank = 1").withColumn("ask_id", F.col("route_id") * 100 + F.col("seq"))
    rows = rows.withColumns({"at_s": F.col("enter_s").cast("long"), "lat": F.lit(city.SITE_LAT), "lon": F.lit(city.SITE_LON)})
    return stage(spark, sf, "asks", lambda: with_sun(rows, "at_s"))


def building_streets(spark, sf):
    return stage(spark, sf, "building_streets", lambda: E.nearest_street(
        city.buildings(spark, sf), city.samples(spark, sf), city.edges(spark, sf)))


@query("nearest_street")
def nearest_street(spark, sf):
    return building_streets(spark, sf).select("building_id", "street_name", F.round("distance", 4).alias("distance_m"))


@query("shaded_by")
def shaded_by(spark, sf):
    out = E.shaded_by(asks(spark, sf), city.samples(spark, sf), shaded(spark, sf), city.buildings(spark, sf), city.trees(spark, sf), building_streets(spark, sf))
    return out.select("ask_id", "shaded_by", "dappled")


UNTIL = {**ROUTES, "until_keys": (("cards", "walked"), f"""
    SELECT route_id * 100 + c.seq AS ask_id, p.edge_id, floor(p.enter_s)::BIGINT AS at_s, i AS step, floor(p.enter_s)::BIGINT + 300 * i AS epoch_s,
           {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon
    FROM cards c JOIN walked p USING (route_id), (SELECT unnest(range(0, 73)) AS i)
    WHERE rank = 1 AND p.seq = CASE c.seq WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 4 END"""),
    "until_instants": (("until_keys",), "SELECT DISTINCT epoch_s, lat, lon FROM until_keys"),
    "until_sun": (("until_instants",), sun_sql("until_instants")),
    "until_edges": (("until_keys", "until_sun"), """
        SELECT DISTINCT edge_id, epoch_s, epoch_s AS minute, 0 AS hour_s, azimuth_deg, elevation_deg FROM until_keys JOIN until_sun USING (epoch_s)""")}
UNTIL["lit_until"] = panel_sql("until_edges")["lit"]


@query("sunlit_until", compose("""
    SELECT ask_id::BIGINT AS ask_id, CASE WHEN min(step) FILTER (WHERE f <= 0.5) > 0 THEN min(epoch_s) FILTER (WHERE f <= 0.5) END::BIGINT AS until_s
    FROM until_keys JOIN (SELECT edge_id, minute AS epoch_s, round(avg(f_sun), 9) AS f FROM lit_until GROUP BY 1, 2) USING (edge_id, epoch_s) GROUP BY 1""", "until_keys", "lit_until", extra=UNTIL))
def sunlit_until(spark, sf):
    asked = asks(spark, sf).select("ask_id", F.col("prev_edge_id").alias("edge_id"), F.floor("prev_enter_s").cast("long").alias("at_s"))
    return E.sunlit_until(asked, shaded(spark, sf), city.SITE_LAT, city.SITE_LON)


@query("turn_why")
def turn_why(spark, sf):
    asked = asks(spark, sf)
    until = E.sunlit_until(asked.select("ask_id", F.col("prev_edge_id").alias("edge_id"), F.col("prev_enter_s").cast("long").alias("at_s")),
                           shaded(spark, sf), city.SITE_LAT, city.SITE_LON)
    shade = E.shaded_by(asked, city.samples(spark, sf), shaded(spark, sf), city.buildings(spark, sf),
                        city.trees(spark, sf), building_streets(spark, sf))
    return R.turn_why(asked, shade, until).select("route_id", "seq", "delta_c", "why_shaded_by", "dappled", "sunlit_until_s")


@query("strip_offsets", compose("""
    SELECT route_id::BIGINT AS route_id, seq::BIGINT AS seq, round(100 * length_m / sum(length_m) OVER (PARTITION BY route_id), 5) AS width_pct,
           CASE WHEN kind = 1 THEN round(100 * sum(length_m) OVER (PARTITION BY route_id ORDER BY seq) / sum(length_m) OVER (PARTITION BY route_id), 5) END AS tick_pct
    FROM legs""", "legs", extra=ROUTES))
def strip_offsets(spark, sf):
    return R.strip_offsets(clocked(spark, sf), KEYS).select(
        "route_id", F.col("seq").cast("long").alias("seq"), F.round("width_pct", 5).alias("width_pct"), F.round("tick_pct", 5).alias("tick_pct"))


@query("orient_geometry", compose("""
    SELECT route_id::BIGINT AS route_id, seq::BIGINT AS seq, CASE WHEN from_node = e.u THEN ax ELSE bx END AS start_x, CASE WHEN from_node = e.u THEN ay ELSE yb END AS start_y
    FROM legs JOIN edges e USING (edge_id)""", "legs", "edges", extra=ROUTES))
def orient_geometry(spark, sf):
    rows = clocked(spark, sf).join(city.edges(spark, sf).select("edge_id", "path"), "edge_id")
    p = R.orient(F.col("path"), F.col("from_node"), F.col("u"))
    return rows.select("route_id", F.col("seq").cast("long").alias("seq"), p[0]["x"].alias("start_x"), p[0]["y"].alias("start_y"))


@query("heat_scale", compose("""
    SELECT route_id::BIGINT AS route_id, seq::BIGINT AS seq, CASE WHEN c >= 46 THEN 'extreme heat stress' WHEN c >= 38 THEN 'very strong heat stress'
             WHEN c >= 32 THEN 'strong heat stress' WHEN c >= 26 THEN 'moderate heat stress' WHEN c >= 9 THEN 'no thermal stress' ELSE 'cold stress' END AS category,
           CASE WHEN c <= 18 THEN 80 WHEN c <= 26 THEN floor(80 + 100 * (c - 18) / 8 + 0.5) WHEN c <= 32 THEN floor(180 + 57 * (c - 26) / 6 + 0.5)
             WHEN c <= 38 THEN floor(237 + 11 * (c - 32) / 6 + 0.5) WHEN c <= 46 THEN floor(248 - 19 * (c - 38) / 8 + 0.5) ELSE 229 END::BIGINT AS red
    FROM (SELECT *, round(mean_feels_like_c, 6) AS c FROM walked)""", "walked", extra=ROUTES))
def heat_scale(spark, sf):
    c = F.round("mean_feels_like_c", 6)
    return walked(spark, sf).select("route_id", F.col("seq").cast("long").alias("seq"), T.heat_category(c).alias("category"), T.heat_rgb(c)[0].cast("long").alias("red"))


@query("unit_columns", compose("""
    SELECT hour_s::BIGINT AS hour_s, floor(air_temp_c * 9 / 5 + 32 + 0.5)::BIGINT::VARCHAR AS air_f, printf('%.1f mph', wind_speed_10m_ms * 2.236936) AS wind,
           CASE WHEN floor(abs(d) + 0.5) = 0 THEN 'the same' ELSE CASE WHEN d < 0 THEN '−' ELSE '+' END || floor(abs(d) + 0.5)::BIGINT || '°' END AS against_27
    FROM (SELECT *, (air_temp_c - 27.013) AS d FROM weather)""", "weather"))
def unit_columns(spark, sf):
    w = city.weather(spark, sf)
    return w.select("hour_s", T.degrees_text(F.col("air_temp_c"), True).alias("air_f"), T.speed_text(F.col("wind_speed_10m_ms"), True).alias("wind"),
                    T.signed_degrees(F.col("air_temp_c") - 27.013).alias("against_27"))


@query("evidence_text", compose("""
    SELECT building_id::BIGINT AS building_id, 'the ' || height_m::BIGINT || ' m ' || CASE WHEN height_m >= 60 THEN 'tower' ELSE 'building' END || ' on Main Street' AS text,
           'the ' || floor(height_m * 3.28084 + 0.5)::BIGINT || ' ft ' || CASE WHEN height_m >= 60 THEN 'tower' ELSE 'building' END || ' on Main Street' AS imperial FROM buildings""", "buildings"))
def evidence_text(spark, sf):
    out = city.buildings(spark, sf).select("building_id", T.building_text(F.col("height_m"), F.lit("Main Street")).alias("text"))
    return out.withColumn("imperial", T.metres_to_feet_in_text(F.col("text")))


@query("rest_text", compose("""
    SELECT amenity_id::BIGINT AS amenity_id, 'Cool off at ' || CASE WHEN name <> '' THEN name ELSE ['Drinking fountain', 'Cooling site', 'Park'][kind + 1] END || ' — a '
           || ['drinking fountain', 'cooling site', 'park'][kind + 1] || CASE WHEN amenity_id % 5 >= 2 THEN ' ' || (amenity_id % 5) // 2 || ' min out of your way' ELSE ' right here' END AS text
    FROM amenities""", "amenities"))
def rest_text(spark, sf):
    detour = F.floor(F.col("amenity_id") % 5 / 2) * 60.0
    return city.amenities(spark, sf).select("amenity_id", T.rest_text(F.col("name"), F.col("kind"), detour).alias("text"))


def leg_places(spark, sf):
    ends = city.nodes(spark, sf, geographic=False).select(F.col("node_id").alias("to_node"), F.col("x_m").alias("end_x"), F.col("y_m").alias("end_y"))
    return walked(spark, sf).withColumn("feels_c", F.col("mean_feels_like_c")).join(ends, "to_node")


@query("amenities_near", compose("""
    SELECT node_id::BIGINT AS place_id, amenity_id::BIGINT AS amenity_id, round(d, 4) AS distance_m, row_number() OVER (PARTITION BY node_id ORDER BY d, amenity_id)::BIGINT AS near_no
    FROM (SELECT node_id, amenity_id, sqrt(pow(n.x_m - a.x_m, 2) + pow(n.y_m - a.y_m, 2)) AS d FROM nodes n, amenities a) WHERE d <= 101.25""", "nodes", "amenities"))
def amenities_near(spark, sf):
    places = city.nodes(spark, sf, geographic=False).withColumnRenamed("node_id", "place_id")
    near = WP.nearest_first(WP.amenities_near(places, city.amenities(spark, sf), 101.25))
    return near.select("place_id", "amenity_id", F.round("distance_m", 4).alias("distance_m"), F.col("near_no").cast("long").alias("near_no"))


@query("rest_stops")
def rest_stops(spark, sf):
    """A lower threshold and a longer detour than the defaults, so that seven-leg walks earn stops."""
    stops = WP.rest_stops(leg_places(spark, sf), city.amenities(spark, sf), KEYS, threshold_dm=1.0, detour_s=900.0)
    return WP.rest_cards(stops, city.amenities(spark, sf), KEYS).select("route_id", "stop_no", "after_seq", "amenity_id", F.round("detour_s", 3).alias("detour_s"), "text")


@query("emit_routes_json")
def emit_routes_json(spark, sf):
    return R.route_documents(walked(spark, sf), R.route_summary(walked(spark, sf), KEYS), KEYS)


SERIES = {**ROUTES,
    "starts": (("legs", "weather"), """
        SELECT route_id, step_no, at_s, (SELECT arg_min(hour_s, abs(hour_s - at_s) * 2 + CASE WHEN hour_s > at_s THEN 1 ELSE 0 END) FROM weather) AS hour_s
        FROM (SELECT DISTINCT route_id, depart_s + 3600 * i AS at_s, i AS step_no FROM legs, (SELECT unnest(range(0, 4)) AS i))"""),
    "clock": (("legs", "starts"), """
        SELECT *, floor(enter_s / 60)::BIGINT AS minute FROM (
          SELECT legs.*, step_no, at_s, hour_s, at_s + coalesce(sum(duration_s) OVER (PARTITION BY route_id, step_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS enter_s
          FROM legs JOIN starts USING (route_id))"""),
    "points": (("walked",), """
        SELECT route_id, step_no, at_s, sum(mean_feels_like_c * length_m) / sum(length_m) AS mean_c, max(mean_feels_like_c) AS max_c,
               sum(mean_f_sun * length_m) / sum(length_m) AS sun_fraction FROM walked GROUP BY 1, 2, 3""")}


def series_points(spark, sf):
    def build():
        legs = plain_legs(spark, sf)
        starts = WX.time_grid(legs.select("route_id", "depart_s").distinct(), "depart_s", F.lit(180.0), 60)
        again = R.route_timeseries(legs, hours_for(starts, spark, sf), KEYS)
        priced = R.with_costs(again, cost_of(again.select("edge_id", "minute", "hour_s"), spark, sf))
        return R.timeseries_points(priced, KEYS)
    return stage(spark, sf, "series", build)


@query("route_timeseries", compose("""
    SELECT route_id::BIGINT AS route_id, step_no::BIGINT AS step_no, at_s::BIGINT AS at_s, round(mean_c, 4) AS mean_c, round(max_c, 4) AS max_c, round(sun_fraction, 5) AS sun_fraction
    FROM points""", "points", extra=SERIES))
def route_timeseries(spark, sf):
    return series_points(spark, sf).select("route_id", F.col("step_no").cast("long").alias("step_no"), "at_s", F.round("mean_c", 4).alias("mean_c"),
                                           F.round("max_c", 4).alias("max_c"), F.round("sun_fraction", 5).alias("sun_fraction"))


@query("series_verdict", compose("""
    SELECT route_id::BIGINT AS route_id, CASE WHEN abs(l - f) < 0.5 AND p - f < 0.5 THEN 'steady' WHEN ps NOT IN (fs, ls) THEN 'peak' WHEN l < f THEN 'falling' ELSE 'rising' END AS verdict
    FROM (SELECT route_id, arg_min(mean_c, at_s) AS f, arg_max(mean_c, at_s) AS l, max(mean_c) AS p, arg_min(at_s, (-mean_c, at_s)) AS ps, min(at_s) AS fs, max(at_s) AS ls FROM (SELECT route_id, at_s, round(mean_c, 6) AS mean_c FROM points) GROUP BY 1)""", "points", extra=SERIES))
def series_verdict(spark, sf):
    points = series_points(spark, sf).withColumn("mean_c", F.round("mean_c", 6))
    return R.series_verdict(points, KEYS).select("route_id", "verdict")


# ---- choices: orders stand for alternative paths of a customer's walk --------

PATHS = {"paths": ((), f"""
    SELECT o_custkey AS walk_id, o_orderkey AS path_no, {city.DAY_START_S} + 46800 + (o_orderkey % 8) * 900 AS depart_s,
           (300 + o_orderkey % 613)::DOUBLE AS duration_s, (100 + (o_totalprice * 100)::BIGINT % 401)::DOUBLE AS heat_dm,
           20 + ((o_totalprice * 100)::BIGINT % 1501) / 100.0::DOUBLE AS mean_c FROM orders"""),
    "named": (("paths",), """
        SELECT *, CASE WHEN i = 0 THEN 'fastest' WHEN i = max(i) OVER (PARTITION BY walk_id) THEN 'coolest' ELSE 'alt' || i END AS route_id
        FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY duration_s, heat_dm) - 1 AS i FROM paths)"""),
    "chosen": (("named",), """
        SELECT walk_id, profile, arg_min(route_id, (score, duration_s, route_id)) AS chosen_route_id FROM (
          SELECT n.walk_id, profile, route_id, n.duration_s, (n.duration_s - b.d0) - m * 60 * (b.c0 - mean_c) AS score
          FROM named n JOIN (SELECT walk_id, min(duration_s) AS d0, arg_min(mean_c, (duration_s, route_id)) AS c0 FROM named GROUP BY 1) b USING (walk_id),
               (VALUES ('standard', 1.0::DOUBLE), ('sensitive', 3.0::DOUBLE), ('high risk', 6.0::DOUBLE)) AS p(profile, m)) GROUP BY 1, 2"""),
    "best": (("paths",), """
        SELECT walk_id, depart_s, arg_min(mean_c, (heat_dm / (duration_s / 60), duration_s)) AS best_mean_c,
               arg_min(duration_s, (heat_dm / (duration_s / 60), duration_s)) AS best_duration_s FROM paths GROUP BY 1, 2"""),
    "numbered_best": (("best",), "SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY depart_s) - 1 AS point_no FROM best")}


def paths(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return city.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("walk_id"), F.col("o_orderkey").alias("path_no"),
        (F.lit(city.DAY_START_S + 46800) + (F.col("o_orderkey") % 8) * 900).cast("long").alias("depart_s"),
        (F.lit(300) + F.col("o_orderkey") % 613).cast("double").alias("duration_s"), (F.lit(100) + cents % 401).cast("double").alias("heat_dm"),
        (F.lit(20.0) + (cents % 1501) / 100.0).alias("mean_c"))


def profiles(spark):
    from ..constants import HEAT_PROFILES
    return spark.createDataFrame(list(HEAT_PROFILES.items()), "profile string, minutes_per_degree double")


@query("pareto_prune", compose("""
    SELECT walk_id::BIGINT AS walk_id, path_no::BIGINT AS path_no FROM (
      SELECT *, min(heat_dm) OVER (PARTITION BY walk_id ORDER BY duration_s, heat_dm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM paths)
    WHERE b IS NULL OR heat_dm < b - 1e-9""", "paths", extra=PATHS))
def pareto_prune(spark, sf):
    return S.pareto_prune(paths(spark, sf)).select("walk_id", "path_no")


@query("route_labels", compose("SELECT walk_id::BIGINT AS walk_id, path_no::BIGINT AS path_no, route_id FROM named", "named", extra=PATHS))
def route_labels(spark, sf):
    return R.route_labels(paths(spark, sf)).select("walk_id", "path_no", "route_id")


@query("alternatives", compose("""
    SELECT walk_id::BIGINT AS walk_id, path_no::BIGINT AS path_no FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY duration_s, path_no) AS i FROM paths) WHERE i <= 3""", "paths", extra=PATHS))
def alternatives(spark, sf):
    return R.alternatives(paths(spark, sf), 3, tie="path_no").select("walk_id", "path_no")


@query("choose_for_profile", compose("SELECT walk_id::BIGINT AS walk_id, profile, chosen_route_id FROM chosen", "chosen", extra=PATHS))
def choose_for_profile(spark, sf):
    return R.choose_for_profile(R.route_labels(paths(spark, sf)), profiles(spark))


def chosen_standard(spark, sf):
    labelled = R.route_labels(paths(spark, sf))
    chosen = R.choose_for_profile(labelled, profiles(spark)).filter("profile = 'standard'").drop("profile")
    return labelled.join(chosen, "walk_id")


@query("order_routes", compose("""
    SELECT walk_id::BIGINT AS walk_id, route_id, row_number() OVER (PARTITION BY walk_id ORDER BY CASE WHEN route_id = chosen_route_id THEN 0 ELSE 1 END, duration_s, route_id)::BIGINT AS place
    FROM named JOIN chosen USING (walk_id) WHERE profile = 'standard'""", "chosen", extra=PATHS))
def order_routes(spark, sf):
    return R.order_routes(chosen_standard(spark, sf)).select("walk_id", "route_id", F.col("place").cast("long").alias("place"))


@query("verdict_text", compose("""
    SELECT walk_id::BIGINT AS walk_id, CASE WHEN same THEN 'The quickest way is also the coolest one here. Nothing to trade.'
      WHEN cooler < 0.5 THEN route_id || ' costs ' || extra || ' min and feels about the same. Take the fast one.'
      WHEN extra <= 0 THEN route_id || ' is ' || floor(abs(cooler) + 0.5)::BIGINT || '° cooler for no extra walking.'
      ELSE extra || CASE WHEN extra = 1 THEN ' extra minute' ELSE ' extra minutes' END || ' buys you ' || floor(abs(cooler) + 0.5)::BIGINT || '°.' END AS text
    FROM (SELECT c.walk_id, c.route_id, c.route_id = 'fastest' AS same, round(f.mean_c - c.mean_c, 6) AS cooler, floor((c.duration_s - f.duration_s) / 60 + 0.5)::BIGINT AS extra
          FROM (SELECT n.* FROM named n JOIN chosen k ON k.walk_id = n.walk_id AND k.chosen_route_id = n.route_id AND profile = 'high risk') c
          JOIN (SELECT * FROM named WHERE route_id = 'fastest') f USING (walk_id))""", "chosen", extra=PATHS))
def verdict_text(spark, sf):
    labelled = R.route_labels(paths(spark, sf))
    chosen = R.choose_for_profile(labelled, profiles(spark)).filter("profile = 'high risk'").drop("profile")
    c = labelled.join(chosen, "walk_id").filter("route_id = chosen_route_id")
    f = labelled.filter("route_id = 'fastest'").select("walk_id", F.col("mean_c").alias("f_mean"), F.col("duration_s").alias("f_dur"))
    text = T.route_verdict(F.col("route_id"), F.col("route_id") == "fastest", F.round(F.col("f_mean") - F.col("mean_c"), 6), F.col("duration_s") - F.col("f_dur"))
    return c.join(f, "walk_id").select("walk_id", text.alias("text"))


def curve(spark, sf):
    best = R.coolest_path(paths(spark, sf).withColumnRenamed("mean_c", "mean_feels_like_c"), ["walk_id"])
    return R.departure_curve(best, ["walk_id"])


@query("coolest", compose("""
    SELECT walk_id::BIGINT AS walk_id, depart_s::BIGINT AS depart_s, best_mean_c, best_duration_s FROM best""", "best", extra=PATHS))
def coolest(spark, sf):
    return R.coolest_path(paths(spark, sf).withColumnRenamed("mean_c", "mean_feels_like_c"), ["walk_id"])


@query("departure_curve_index", compose("""
    SELECT walk_id::BIGINT AS walk_id, depart_s::BIGINT AS depart_s, point_no::BIGINT AS point_no,
           first_value(point_no) OVER (PARTITION BY walk_id ORDER BY best_mean_c, point_no)::BIGINT AS best_index FROM numbered_best""", "numbered_best", extra=PATHS))
def departure_curve_index(spark, sf):
    return curve(spark, sf).select("walk_id", "depart_s", F.col("point_no").cast("long").alias("point_no"), F.col("best_index").cast("long").alias("best_index"))


@query("best_daylight_departure", compose(f"""
    SELECT walk_id::BIGINT AS walk_id, best_depart_s::BIGINT AS best_depart_s, ((best_depart_s - now_s) / 60)::BIGINT AS wait_min, round(now_c - best_c, 4) AS saving_c FROM (
      SELECT b.walk_id, now_s, now_c, arg_min(depart_s, (best_mean_c, depart_s)) AS best_depart_s, min(best_mean_c) AS best_c
      FROM best b JOIN (SELECT walk_id, min(depart_s) AS now_s, arg_min(best_mean_c, depart_s) AS now_c FROM best GROUP BY 1) n USING (walk_id)
      WHERE depart_s <= {city.DAY_START_S + 50400} OR depart_s = now_s GROUP BY 1, 2, 3)""", "best", extra=PATHS))
def best_daylight_departure(spark, sf):
    points = curve(spark, sf)
    sunset = points.select("walk_id").distinct().withColumn("sunset_s", F.lit(city.DAY_START_S + 50400))
    return R.best_daylight_departure(points, sunset, ["walk_id"]).select("walk_id", "best_depart_s", "wait_min", F.round("saving_c", 4).alias("saving_c"))


# ---- daylight ------------------------------------------------------------------

DAYS = {"days": ((), """SELECT DISTINCT epoch(date_trunc('day', ts))::BIGINT + 18000 AS day_s FROM events"""),
        "day_minutes": (("days",), f"""SELECT day_s, day_s + 60 * i AS epoch_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon FROM days, (SELECT unnest(range(0, 1440)) AS i)"""),
        "day_sun": (("day_minutes",), sun_sql("day_minutes"))}


def days(spark, sf):
    day = (F.floor(city.epoch_seconds(F.col("ts")) / 86400) * 86400 + 18000).cast("long")
    return city.read(spark, sf, "events").select(day.alias("day_s")).distinct().withColumns({"lat": F.lit(city.SITE_LAT), "lon": F.lit(city.SITE_LON)})


@query("daylight", compose("""
    SELECT day_s::BIGINT AS day_s, min(epoch_s)::BIGINT AS sunrise_s, max(epoch_s)::BIGINT AS sunset_s FROM day_sun WHERE elevation_deg > -0.833 GROUP BY 1""", "day_sun", extra=DAYS))
def daylight(spark, sf):
    return D.daylight_window(days(spark, sf)).select("day_s", "sunrise_s", "sunset_s")


@query("elevation_track", compose("""
    SELECT day_s::BIGINT AS day_s, epoch_s::BIGINT AS epoch_s, round(elevation_deg, 5) AS elevation_deg FROM day_sun WHERE (epoch_s - day_s) % 900 = 0""", "day_sun", extra=DAYS))
def elevation_track(spark, sf):
    out = D.elevation_track(days(spark, sf)).filter("epoch_s < day_s + 86400")
    return out.select("day_s", "epoch_s", F.round("elevation_deg", 5).alias("elevation_deg"))
