"""Trips: bounded walk times, corridors, frontiers and fastest walks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import exposure as X
from ..operators import graph as GR
from ..operators import routes as R
from ..operators import search as S
from ..operators import weather as WX
from ..operators.components import components
from ..session import materialize
from . import derived_city as city
from .oracle import compose
from .registry import query, stage
from .thermal_queries import EXTRA, cost_of, hours_for, panel_sql, sun_sql


def timed_arcs(spark, sf):
    e = city.edges(spark, sf)
    return stage(spark, sf, "arcs", lambda: GR.arcs(e.withColumn("duration_s", X.walk_duration(F.col("length_m"), F.col("kind")))))


def labelled_nodes(spark, sf):
    return stage(spark, sf, "node_components", lambda: components(city.edges(spark, sf).select("u", "v"), city.nodes(spark, sf, geographic=False)))


def live_trips(spark, sf):
    return stage(spark, sf, "trips", lambda: S.reachable_trips(city.trips(spark, sf), labelled_nodes(spark, sf)))


def remaining(spark, sf):
    """Walk times of all nodes within the budgets of the destinations."""
    return stage(spark, sf, "remaining", lambda: S.walk_time_to_target(live_trips(spark, sf), timed_arcs(spark, sf)))


def toward(spark, sf):
    """Walk times of the nodes that some walk within its budget can pass: all that corridors and fastest walks meet.

    Places come from the ends of the edges, so that no arc is lost for a node that the node table lacks.
    """
    ends = city.edges(spark, sf).select(F.explode(F.array(
        F.struct(F.col("u").alias("node_id"), F.col("path")[0].alias("p")), F.struct(F.col("v").alias("node_id"), F.element_at("path", -1).alias("p")))).alias("e"))
    places = ends.groupBy("e.node_id").agg(F.min("e.p.x").alias("x_m"), F.min("e.p.y").alias("y_m"))
    return stage(spark, sf, "toward", lambda: S.walk_time_to_target(live_trips(spark, sf), timed_arcs(spark, sf), places))


def corridor(spark, sf):
    return stage(spark, sf, "corridor", lambda: S.corridor_arcs(
        live_trips(spark, sf), timed_arcs(spark, sf), toward(spark, sf), city.nodes(spark, sf, geographic=False)))


def walks(spark, sf):
    asks = live_trips(spark, sf).withColumn("at_s", F.col("depart_s"))
    return stage(spark, sf, "walks", lambda: hours_for(asks, spark, sf).select(
        F.col("trip_id").alias("walk_id"), "trip_id", "origin", "destination", "depart_s", "hour_s"))


def walk_costs(spark, sf):
    return stage(spark, sf, "walk_costs", lambda: cost_of(materialize(S.required_keys(walks(spark, sf), corridor(spark, sf)), "keys"), spark, sf))


#: buckets so fine that dominance is exact, as the SQL is
EXACT_DM = 1e-6
_LABELS: dict[tuple, S.LabelStore] = {}


def labels(spark, sf):
    """Labels of every trip at its own departure, searched once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LABELS:
        _LABELS[key] = S.pareto_labels(walks(spark, sf), corridor(spark, sf), walk_costs(spark, sf), EXACT_DM)
    return _LABELS[key]


def frontier(spark, sf):
    return stage(spark, sf, "frontier", lambda: S.pareto_walks(labels(spark, sf)))


def numbered_frontier(spark, sf):
    """Frontier paths numbered by duration."""
    order = W.partitionBy("walk_id").orderBy("duration_s", "heat_dm")
    return frontier(spark, sf).withColumn("path_no", F.row_number().over(order).cast("long"))


def searched_legs(spark, sf):
    """Every edge of every frontier path, in order, with its columns."""
    e = city.edges(spark, sf).withColumn("duration_s", X.walk_duration(F.col("length_m"), F.col("kind")))
    keep = e.select("edge_id", "kind", "side", "street_name", "length_m", "bearing_deg", "u", "duration_s")
    return stage(spark, sf, "searched_legs", lambda: S.path_legs(S.reconstruct_paths(numbered_frontier(spark, sf), labels(spark, sf), ["walk_id", "path_no"]), keep))


# walk times on the grid in closed form: blocks apart, plus a crossing when sides differ
TIMES = {
    "place": (("corners", "sides"), "SELECT 2 * k + s AS node_id, s, col, row, borough FROM corners, sides"),
    "live": (("trips", "place"), """
        SELECT t.*, (abs(a.col - b.col) + abs(a.row - b.row)) * 80 / 1.35::DOUBLE AS fastest_s, a.col AS acol, a.row AS arow,
               b.col AS bcol, b.row AS brow, a.borough
        FROM trips t JOIN place a ON a.node_id = origin JOIN place b ON b.node_id = destination WHERE a.borough = b.borough"""),
    "left_s": (("live", "place"), """
        SELECT trip_id, node_id, fastest_s, fastest_s + 120 AS budget_s, t FROM (
          SELECT l.*, p.node_id, (abs(p.col - bcol) + abs(p.row - brow)) * 80 / 1.35::DOUBLE + p.s * (sqrt(512) / 1.35 + 20) AS t
          FROM live l JOIN place p ON p.borough = l.borough AND abs(p.col - bcol) + abs(p.row - brow) <= 8)
        WHERE t <= fastest_s + 120"""),
    "out_s": (("live", "place"), """
        SELECT trip_id, p.node_id, (abs(p.col - acol) + abs(p.row - arow)) * 80 / 1.35::DOUBLE + p.s * (sqrt(512) / 1.35 + 20) AS t
        FROM live l JOIN place p ON p.borough = l.borough AND abs(p.col - acol) + abs(p.row - arow) <= 8"""),
    "fits": (("left_s", "out_s", "edges"), """
        SELECT o.trip_id, edge_id, o.t AS earliest_s, budget_s - d - l.t AS latest_s FROM (
          SELECT edge_id, u AS a, v AS b, length_m / 1.35 + 20 * kind AS d FROM edges
          UNION ALL SELECT edge_id, v, u, length_m / 1.35 + 20 * kind FROM edges) e
        JOIN out_s o ON o.node_id = a JOIN left_s l ON l.node_id = b AND l.trip_id = o.trip_id
        WHERE o.t + d + l.t <= budget_s + 1e-9"""),
}


@query("walk_time_to_target", compose("""
    SELECT trip_id::BIGINT AS trip_id, node_id::BIGINT AS node_id, round(t, 4) AS remaining_s, round(budget_s, 4) AS budget_s FROM left_s""", "left_s", extra=TIMES))
def walk_time_to_target(spark, sf):
    return S.trip_bounds(live_trips(spark, sf), remaining(spark, sf)).select("trip_id", "node_id", F.round("remaining_s", 4).alias("remaining_s"), F.round("budget_s", 4).alias("budget_s"))


@query("corridor_edges", compose("""
    SELECT trip_id::BIGINT AS trip_id, edge_id::BIGINT AS edge_id, round(min(earliest_s), 4) AS earliest_s, round(max(latest_s), 4) AS latest_s
    FROM fits GROUP BY 1, 2""", "fits", extra=TIMES))
def corridor_edges(spark, sf):
    return S.corridor_edges(corridor(spark, sf)).select(
        "trip_id", "edge_id", F.round("earliest_s", 4).alias("earliest_s"), F.round("latest_s", 4).alias("latest_s"))


@query("required_keys", compose("""
    SELECT DISTINCT edge_id::BIGINT AS edge_id, minute::BIGINT AS minute FROM (
      SELECT edge_id, unnest(range(floor((depart_s + lo) / 60)::BIGINT, floor((depart_s + hi) / 60)::BIGINT + 1)) AS minute
      FROM (SELECT trip_id, edge_id, min(earliest_s) AS lo, max(latest_s) AS hi FROM fits GROUP BY 1, 2) JOIN live USING (trip_id))""", "fits", "live", extra=TIMES))
def required_keys(spark, sf):
    return S.required_keys(walks(spark, sf), corridor(spark, sf)).select("edge_id", "minute").distinct()


@query("fastest_walk", compose("""
    SELECT trip_id::BIGINT AS trip_id, round(fastest_s, 4) AS duration_s, (abs(acol - bcol) + abs(arow - brow))::BIGINT AS n_edges FROM live""", "live", extra=TIMES))
def fastest_walk(spark, sf):
    steps = S.fastest_walk(live_trips(spark, sf), timed_arcs(spark, sf), toward(spark, sf))
    out = steps.groupBy("trip_id").agg(F.sum("duration_s").alias("duration_s"), F.count(F.lit(1)).alias("n_edges"))
    return out.select("trip_id", F.round("duration_s", 4).alias("duration_s"), "n_edges")


@query("judged_trips", compose("""
    SELECT trip_id::BIGINT AS trip_id, CASE WHEN a.borough IS NULL OR b.borough IS NULL THEN 'an end is not on the network' WHEN origin = destination THEN 'both ends are the same'
           WHEN a.borough <> b.borough THEN 'no walk joins the ends' END AS reject
    FROM trips LEFT JOIN place a ON a.node_id = origin LEFT JOIN place b ON b.node_id = destination""", "trips", "place", extra=TIMES))
def judged_trips(spark, sf):
    """Every trip with the reason why it is not searched for."""
    return S.judged_trips(city.trips(spark, sf), labelled_nodes(spark, sf)).select("trip_id", "reject")


WALK_COST = {
    **EXTRA, **TIMES,
    "walk_hours": (("live", "weather"), """
        SELECT trip_id, depart_s, arg_min(hour_s, abs(hour_s - depart_s) * 2 + CASE WHEN hour_s > depart_s THEN 1 ELSE 0 END) AS hour_s
        FROM live, weather GROUP BY trip_id, depart_s"""),
    "need": (("fits", "walk_hours"), """
        SELECT DISTINCT edge_id, hour_s, unnest(range(floor((depart_s + lo) / 60)::BIGINT, floor((depart_s + hi) / 60)::BIGINT + 1)) AS minute
        FROM (SELECT trip_id, edge_id, min(earliest_s) AS lo, max(latest_s) AS hi FROM fits GROUP BY 1, 2) JOIN walk_hours USING (trip_id)"""),
    "walk_minutes": (("need",), f"""
        SELECT DISTINCT minute, minute * 60 AS epoch_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon FROM need"""),
    "walk_sun": (("walk_minutes",), sun_sql("walk_minutes")),
    "walk_keys": (("need", "walk_sun"), "SELECT n.edge_id, n.hour_s, s.* FROM need n JOIN walk_sun s ON s.minute = n.minute"),
    **panel_sql("walk_keys"),
}


@query("edge_minute_cost", compose("""
    SELECT edge_id::BIGINT AS edge_id, minute::BIGINT AS minute, hour_s::BIGINT AS hour_s, round(mean_feels_like_c * duration_s / 60, 4) AS heat_dm
    FROM cost""", "cost", extra=WALK_COST))
def edge_minute_cost(spark, sf):
    return walk_costs(spark, sf).select("edge_id", "minute", "hour_s", F.round("heat_dm", 4).alias("heat_dm"))


# every walk that fits its budget and meets no node twice, cost taken at the minute an edge is entered; then the frontier
FOUND = {
    **WALK_COST,
    "hop": (("edges", "out_s", "left_s"), """
        SELECT o.trip_id, edge_id, a, b, d, l.t AS rest_s, budget_s FROM (
          SELECT edge_id, u AS a, v AS b, length_m / 1.35 + 20 * kind AS d FROM edges
          UNION ALL SELECT edge_id, v, u, length_m / 1.35 + 20 * kind FROM edges) e
        JOIN out_s o ON o.node_id = a JOIN left_s l ON l.node_id = b AND l.trip_id = o.trip_id WHERE o.t + d + l.t <= budget_s + 1e-9"""),
    "starts": (("live", "walk_hours"), "SELECT trip_id AS walk_id, trip_id, origin, destination, live.depart_s, hour_s FROM live JOIN walk_hours USING (trip_id)"),
    "tries": (("starts", "hop", "cost"), """
        SELECT walk_id, trip_id, depart_s, hour_s, destination, origin AS node, 0.0::DOUBLE AS arrival_s, 0.0::DOUBLE AS heat, 0.0::DOUBLE AS feels,
               [origin]::BIGINT[] AS nodes, []::BIGINT[] AS walked FROM starts
        UNION ALL SELECT w.walk_id, w.trip_id, w.depart_s, w.hour_s, w.destination, h.b, arrival_s + d, heat + mean_feels_like_c * duration_s / 60, feels + mean_feels_like_c * d,
               list_append(nodes, h.b), list_append(walked, h.edge_id)
        FROM tries w JOIN hop h ON h.trip_id = w.trip_id AND h.a = w.node AND NOT list_contains(nodes, h.b) AND arrival_s + d + rest_s <= budget_s + 1e-9
        JOIN cost c ON c.edge_id = h.edge_id AND c.minute = floor((w.depart_s + arrival_s) / 60)::BIGINT AND c.hour_s = w.hour_s
        WHERE w.node <> w.destination"""),
    "front": (("tries",), """
        SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY arrival_s, heat) AS path_no FROM (
          SELECT *, min(heat) OVER (PARTITION BY walk_id ORDER BY arrival_s, heat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM tries WHERE node = destination)
        WHERE best IS NULL OR heat < best - 1e-9"""),
}


def recursive(sql: str) -> str:
    """What every step of the recursion reads is computed once."""
    for name in ("hop", "cost", "starts"):
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (", 1)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("pareto_walks", recursive(compose("""
    SELECT walk_id::BIGINT AS walk_id, path_no::BIGINT AS path_no, len(walked)::BIGINT AS n_edges, round(arrival_s, 3) AS duration_s, round(heat, 3) AS heat_dm, round(feels / arrival_s, 3) AS mean_feels_like_c
    FROM front""", "front", extra=FOUND)))
def pareto_walks(spark, sf):
    return numbered_frontier(spark, sf).select(
        "walk_id", "path_no", F.col("hops").cast("long").alias("n_edges"), F.round("duration_s", 3).alias("duration_s"), F.round("heat_dm", 3).alias("heat_dm"),
        F.round("mean_feels_like_c", 3).alias("mean_feels_like_c"))


@query("reconstruct_paths", recursive(compose("""
    SELECT walk_id::BIGINT AS walk_id, path_no::BIGINT AS path_no, (i - 1)::BIGINT AS seq, walked[i]::BIGINT AS edge_id, nodes[i]::BIGINT AS from_node FROM (
      SELECT *, unnest(range(1, len(walked) + 1)) AS i FROM front)""", "front", extra=FOUND)))
def reconstruct_paths(spark, sf):
    return searched_legs(spark, sf).select("walk_id", "path_no", F.col("seq").cast("long").alias("seq"), "edge_id", "from_node")


# every trip again at each quarter of the hour after its departure
SWEPT = {
    **FOUND,
    "sweep": (("live",), "SELECT trip_id, origin, destination, depart_s + 900 * k AS depart_s, k FROM live, (SELECT unnest(range(0, 4)) AS k)"),
    "walk_hours": (("sweep", "weather"), """
        SELECT DISTINCT ON (trip_id, depart_s) s.trip_id, s.depart_s, h.hour_s FROM sweep s JOIN (
          SELECT depart_s, arg_min(hour_s, abs(hour_s - depart_s) * 2 + CASE WHEN hour_s > depart_s THEN 1 ELSE 0 END) AS hour_s
          FROM (SELECT DISTINCT depart_s FROM sweep), weather GROUP BY 1) h ON h.depart_s = s.depart_s"""),
    "starts": (("sweep", "walk_hours"), "SELECT s.trip_id * 100 + k AS walk_id, s.trip_id, origin, destination, s.depart_s, hour_s FROM sweep s JOIN walk_hours h ON h.trip_id = s.trip_id AND h.depart_s = s.depart_s"),
    "coolest": (("front",), """
        SELECT trip_id, depart_s, arg_min(feels / arrival_s, (heat / greatest(arrival_s / 60, 1e-6), arrival_s)) AS best_mean_c,
               arg_min(arrival_s, (heat / greatest(arrival_s / 60, 1e-6), arrival_s)) AS best_duration_s FROM front GROUP BY 1, 2"""),
    "points": (("coolest",), "SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY depart_s) - 1 AS point_no FROM coolest"),
}


@query("departure_curve", recursive(compose("""
    SELECT trip_id::BIGINT AS trip_id, depart_s::BIGINT AS depart_s, point_no::BIGINT AS point_no, first_value(point_no) OVER (PARTITION BY trip_id ORDER BY round(best_mean_c, 6), point_no)::BIGINT AS best_index,
           round(best_mean_c, 3) AS best_mean_c, round(best_duration_s, 3) AS best_duration_s FROM points""", "points", extra=SWEPT)))
def departure_curve(spark, sf):
    """Every trip searched at four departures of the next hour; the bounds of its ends serve them all."""
    def build():
        starts = live_trips(spark, sf).select("trip_id", "origin", "destination", "depart_s")
        swept = WX.departures(starts, 1).withColumn("at_s", F.col("depart_s"))
        asked = hours_for(swept, spark, sf).withColumn("walk_id", F.col("trip_id") * 100 + F.col("depart_no"))
        asked = asked.select("walk_id", "trip_id", "origin", "destination", "depart_s", "hour_s")
        band = corridor(spark, sf)
        keys = materialize(S.required_keys(asked, band), "keys")
        found = S.pareto_labels(asked, band, materialize(cost_of(keys, spark, sf), "costs"), EXACT_DM)
        return R.departure_curve(R.coolest_path(S.pareto_walks(found), ["trip_id"]), ["trip_id"])
    return stage(spark, sf, "departure_curve", build).select(
        "trip_id", "depart_s", F.col("point_no").cast("long").alias("point_no"), F.col("best_index").cast("long").alias("best_index"), F.round("best_mean_c", 3).alias("best_mean_c"), F.round("best_duration_s", 3).alias("best_duration_s"))
