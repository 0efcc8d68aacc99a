"""Building the walking graph, and the health checks on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import checks as K
from ..operators import graph as GR
from ..operators.components import components
from ..operators.scene import build_crowns, species_tau
from ..sources import tables as T
from . import derived_city as city
from .oracle import compose
from .registry import query, stage
from .shade_queries import horizon_table

WIDTHS_FT = (None, 30.0, 70.0, 50.0, 140.0)


def streets(spark, sf):
    """Centrelines of the blocks, bent in the middle by up to four metres."""
    b = city.blocks(spark, sf)
    x, y = F.lit(city.X0) + F.col("col") * city.BLOCK_M, F.lit(city.Y0) + F.col("row") * city.BLOCK_M
    bend = (F.col("k") % 3) * 2
    path = F.when(F.col("dir") == 0, G.path_of((x, y), (x + 40, y + bend), (x + 80, y))).otherwise(
        G.path_of((x, y), (x + bend, y + 40), (x, y + 80)))
    widths = F.array(*[F.lit(w).cast("double") for w in WIDTHS_FT])
    return b.select((F.col("k") * 2 + F.col("dir")).alias("seq"), "physical_id", "street_name", "borough",
                    (F.element_at(widths, (F.col("k") % 5 + 1).cast("int")) * 0.3048).alias("street_width_m"), path.alias("path"))


STREETS = {
    "streets": (("blocks",), """
        SELECT 2 * k + dir AS seq, physical_id, street_name, borough, dir,
               CASE k % 5 WHEN 0 THEN 6.0 WHEN 1 THEN 30 * 0.3048 / 2 + 2 WHEN 2 THEN 70 * 0.3048 / 2 + 2
                          WHEN 3 THEN 50 * 0.3048 / 2 + 2 ELSE 120 * 0.3048 / 2 + 2 END::DOUBLE AS off,
               (300000 + 80 * col)::DOUBLE AS x, (64000 + 80 * row)::DOUBLE AS y, ((k % 3) * 2)::DOUBLE AS bend FROM blocks"""),
    # along and across the street: both halves lean by the bend over forty metres
    "sidewalks": (("streets", "sides"), """
        SELECT seq, s AS side, physical_id, street_name, borough, dir, len,
               CASE dir WHEN 0 THEN x + a0 ELSE x - o0 END AS x0, CASE dir WHEN 0 THEN y + o0 ELSE y + a0 END AS y0,
               CASE dir WHEN 0 THEN x + a1 ELSE x - o1 END AS x1, CASE dir WHEN 0 THEN y + o1 ELSE y + a1 END AS y1,
               CASE dir WHEN 0 THEN x + a2 ELSE x - o2 END AS x2, CASE dir WHEN 0 THEN y + o2 ELSE y + a2 END AS y2
        FROM (SELECT *, -d * lean / h AS a0, d * 40 / h AS o0, 40.0 AS a1, sb + d * h / 40 AS o1,
                     80 + d * lean / h AS a2, d * 40 / h AS o2,
                     2 * sqrt(pow(40 + d * lean / h, 2) + pow(sb + d * h / 40 - d * 40 / h, 2)) AS len
              FROM (SELECT *, sb AS lean FROM (
                SELECT *, CASE s WHEN 0 THEN off ELSE -off END AS d, CASE dir WHEN 0 THEN bend ELSE -bend END AS sb,
                       sqrt(1600 + bend * bend) AS h FROM streets, sides)))"""),
    "ends": (("sidewalks",), """
        SELECT seq, side, 'u' AS which, (seq * 2 + side) * 2 AS ord, x0 AS x, y0 AS y, borough FROM sidewalks
        UNION ALL SELECT seq, side, 'v', (seq * 2 + side) * 2 + 1, x2, y2, borough FROM sidewalks"""),
    "g_nodes": (("ends",), """
        SELECT row_number() OVER (ORDER BY ord) - 1 AS node_id, sx, sy, x AS x_m, y AS y_m, borough FROM (
          SELECT round_even(x, 0) AS sx, round_even(y, 0) AS sy, min(ord) AS ord, arg_min(x, ord) AS x, arg_min(y, ord) AS y,
                 arg_min(borough, ord) AS borough FROM ends GROUP BY 1, 2)"""),
    "g_edges": (("sidewalks", "ends", "g_nodes"), """
        SELECT row_number() OVER (ORDER BY s.seq * 2 + s.side) - 1 AS edge_id, n.u, n.v, s.* FROM sidewalks s JOIN (
          SELECT seq, side, max(CASE which WHEN 'u' THEN node_id END) AS u, max(CASE which WHEN 'v' THEN node_id END) AS v
          FROM ends JOIN g_nodes ON sx = round_even(ends.x, 0) AND sy = round_even(ends.y, 0) GROUP BY 1, 2) n USING (seq, side)"""),
    "end_rows": (("g_edges", "g_nodes"), """
        SELECT edge_id + w * n AS row_id, node_id, x_m, y_m, street_name, physical_id FROM (
          SELECT *, CASE w WHEN 0 THEN u ELSE v END AS node_id FROM g_edges, (SELECT unnest([0, 1]) AS w), (SELECT count(*) AS n FROM g_edges))
        JOIN g_nodes USING (node_id)"""),
    "cands": (("end_rows",), """
        SELECT a.row_id AS i, b.row_id AS j, a.node_id AS u, b.node_id AS v, sqrt(pow(a.x_m - b.x_m, 2) + pow(a.y_m - b.y_m, 2)) AS span_m
        FROM (SELECT *, floor(x_m / 40) AS cx, floor(y_m / 40) AS cy FROM end_rows) a
        JOIN (SELECT *, floor(x_m / 40) + dx AS cx, floor(y_m / 40) + dy AS cy FROM end_rows, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) b
          USING (cx, cy)
        WHERE a.row_id < b.row_id AND a.physical_id <> b.physical_id AND a.node_id <> b.node_id
          AND sqrt(pow(a.x_m - b.x_m, 2) + pow(a.y_m - b.y_m, 2)) <= 40 AND (a.x_m <> b.x_m OR a.y_m <> b.y_m)"""),
    "numbered": (("edges",), """
        SELECT row_number() OVER (ORDER BY edge_id) - 1 AS no, sum(c) OVER (ORDER BY edge_id) - c AS sample_start, c AS sample_count, *
        FROM (SELECT *, greatest(2, ceil(length_m / 10) + 1)::BIGINT AS c FROM edges)"""),
}


# crossings: all short links, and those long ones whose sides no shorter link joins
CROSSINGS = {
    **STREETS,
    "ranked": (("cands",), "SELECT *, row_number() OVER (ORDER BY round(span_m, 3), i, j) AS r FROM cands"),
    "short_pairs": (("ranked",), "SELECT i AS a, j AS b FROM ranked WHERE span_m <= 15 UNION ALL SELECT j, i FROM ranked WHERE span_m <= 15"),
    "reach": (("ranked", "short_pairs"), """
        SELECT i AS a, i AS b FROM ranked UNION SELECT j, j FROM ranked
        UNION SELECT reach.a, s.b FROM reach JOIN short_pairs s ON s.a = reach.b"""),
    "blob": (("reach",), "SELECT a AS id, min(b) AS c FROM reach GROUP BY a"),
    "long_links": (("ranked", "blob"), """
        SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, min(r) AS r FROM ranked JOIN blob x ON x.id = i JOIN blob y ON y.id = j
        WHERE span_m > 15 AND x.c <> y.c GROUP BY 1, 2"""),
    "long_arcs": (("long_links",), "SELECT a, b, r FROM long_links UNION ALL SELECT b, a, r FROM long_links"),
    # a long link stays unless shorter ones already join its two sides
    "flood": (("long_links", "long_arcs"), """
        SELECT r AS e, a AS here, b AS goal FROM long_links UNION SELECT f.e, t.b, f.goal FROM flood f JOIN long_arcs t ON t.a = f.here AND t.r < f.e"""),
    "crossings": (("ranked", "long_links", "flood", "end_rows", "g_edges"), """
        SELECT n + row_number() OVER (ORDER BY r) - 1 AS edge_id, c.u, c.v, 1 AS kind, -1 AS side, a.street_name || ' / ' || b.street_name AS street_name, -1 AS physical_id,
               c.span_m AS len, (degrees(atan2(b.x_m - a.x_m, b.y_m - a.y_m)) + 360) % 360 AS bearing, a.x_m AS x0, a.y_m AS y0, b.x_m AS x1, b.y_m AS y1, b.x_m AS x2, b.y_m AS y2
        FROM ranked c JOIN end_rows a ON a.row_id = c.i JOIN end_rows b ON b.row_id = c.j, (SELECT count(*) AS n FROM g_edges)
        WHERE c.span_m <= 15 OR r IN (SELECT r FROM long_links WHERE r NOT IN (SELECT e FROM flood WHERE here = goal))"""),
    "full_edges": (("g_edges", "crossings"), """
        SELECT *, sum(c) OVER (ORDER BY edge_id) - c AS sample_start FROM (SELECT *, greatest(2, ceil(len::FLOAT::DOUBLE / 10) + 1)::BIGINT AS c FROM (
          SELECT edge_id, u, v, 0 AS kind, side, street_name, physical_id, len, (degrees(atan2(x2 - x0, y2 - y0)) + 360) % 360 AS bearing, x0, y0, x1, y1, x2, y2 FROM g_edges
          UNION ALL SELECT edge_id, u, v, kind, side, street_name, physical_id, len, bearing, x0, y0, x1, y1, x2, y2 FROM crossings))"""),
    "full_samples": (("full_edges",), """
        SELECT (sample_start + i)::BIGINT AS sample_id, edge_id, t, CASE WHEN kind = 1 THEN x0 + (x1 - x0) * t WHEN t <= 0.5 THEN x0 + (x1 - x0) * 2 * t ELSE x1 + (x2 - x1) * (2 * t - 1) END AS x_m,
               CASE WHEN kind = 1 THEN y0 + (y1 - y0) * t WHEN t <= 0.5 THEN y0 + (y1 - y0) * 2 * t ELSE y1 + (y2 - y1) * (2 * t - 1) END AS y_m
        FROM (SELECT *, i / (c - 1)::DOUBLE AS t FROM (SELECT *, unnest(range(0, c)) AS i FROM full_edges))"""),
}


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def built_graph(spark, sf):
    built = {}

    def build(part):
        if not built:
            built["nodes"], built["edges"] = GR.sidewalk_edges(streets(spark, sf))
        return built[part]
    return (stage(spark, sf, "g_nodes", lambda: build("nodes")), stage(spark, sf, "g_edges", lambda: build("edges")))


def numbered_edges(spark, sf):
    return stage(spark, sf, "numbered", lambda: GR.with_sample_blocks(GR.number_edges(city.edges(spark, sf))))


def city_table(spark, sf, name):
    """One of the six tables in contract form; no other is built for it."""
    def build():
        if name in ("edges", "samples"):
            edges = numbered_edges(spark, sf)
            land = {"ground_albedo": F.lit(0.25), "landcover_class": F.lit(7)}
            return T.conform(name, edges if name == "edges" else GR.sample_points(edges).withColumns(land))
        return T.conform(name, getattr(city, name)(spark, sf))
    return stage(spark, sf, f"city_{name}", build)


def city_tables(spark, sf):
    """The six tables in contract form."""
    return {n: city_table(spark, sf, n) for n in ("nodes", "edges", "samples", "buildings", "trees", "amenities")}


# ---- building --------------------------------------------------------------

@query("offset_for", compose("SELECT seq::BIGINT AS seq, round(off, 6) AS offset_m FROM streets", "streets", extra=STREETS))
def offset_for(spark, sf):
    return streets(spark, sf).select("seq", F.round(GR.offset_for(F.col("street_width_m") / 0.3048), 6).alias("offset_m"))


@query("sidewalk_edges", compose("""
    SELECT edge_id::BIGINT AS edge_id, u::BIGINT AS u, v::BIGINT AS v, side::BIGINT AS side, physical_id::BIGINT AS physical_id, street_name,
           round(len, 4) AS length_m, round((degrees(atan2(x2 - x0, y2 - y0)) + 360) % 360, 4) AS bearing_deg,
           round(x1, 3) AS mid_x, round(y1, 3) AS mid_y FROM g_edges""", "g_edges", extra=STREETS))
def sidewalk_edges(spark, sf):
    e = built_graph(spark, sf)[1]
    return e.select("edge_id", "u", "v", F.col("side").cast("long").alias("side"), "physical_id", "street_name",
                    F.round("length_m", 4).alias("length_m"), F.round("bearing_deg", 4).alias("bearing_deg"),
                    F.round(F.col("path")[1]["x"], 3).alias("mid_x"), F.round(F.col("path")[1]["y"], 3).alias("mid_y"))


@query("snap_nodes", compose("""
    SELECT node_id::BIGINT AS node_id, round(x_m, 4) AS x_m, round(y_m, 4) AS y_m, borough FROM g_nodes""", "g_nodes", extra=STREETS))
def snap_nodes(spark, sf):
    return built_graph(spark, sf)[0].select("node_id", F.round("x_m", 4).alias("x_m"), F.round("y_m", 4).alias("y_m"), "borough")


@query("endpoint_union", compose("""
    SELECT row_id::BIGINT AS row_id, node_id::BIGINT AS node_id, physical_id::BIGINT AS physical_id, round(x_m, 4) AS x_m FROM end_rows""", "end_rows", extra=STREETS))
def endpoint_union(spark, sf):
    return GR.endpoint_rows(*built_graph(spark, sf)).select("row_id", "node_id", "physical_id", F.round("x_m", 4).alias("x_m"))


@query("crossing_candidates", compose("""
    SELECT i::BIGINT AS i, j::BIGINT AS j, u::BIGINT AS u, v::BIGINT AS v, round(span_m, 5) AS span_m FROM cands""", "cands", extra=STREETS))
def crossing_candidates(spark, sf):
    out = GR.crossing_candidates(GR.endpoint_rows(*built_graph(spark, sf)))
    return out.select("i", "j", "u", "v", F.round("span_m", 5).alias("span_m"))


def full_graph(spark, sf):
    return stage(spark, sf, "full_graph", lambda: GR.add_crossings(*built_graph(spark, sf)))


@query("select_crossings", recursive(compose("""
    SELECT edge_id::BIGINT AS edge_id, u::BIGINT AS u, v::BIGINT AS v, round(len, 5) AS span_m FROM crossings""", "crossings", extra=CROSSINGS)))
def select_crossings(spark, sf):
    out = full_graph(spark, sf).filter("kind = 1")
    return out.select("edge_id", "u", "v", F.round("length_m", 5).alias("span_m"))


@query("append_crossings", recursive(compose("""
    SELECT edge_id::BIGINT AS edge_id, kind::BIGINT AS kind, u::BIGINT AS u, v::BIGINT AS v, street_name, physical_id::BIGINT AS physical_id, round(len, 4) AS length_m, round(bearing, 3) AS bearing_deg
    FROM full_edges""", "full_edges", extra=CROSSINGS)))
def append_crossings(spark, sf):
    return full_graph(spark, sf).select("edge_id", F.col("kind").cast("long").alias("kind"), "u", "v", "street_name", "physical_id",
                                        F.round("length_m", 4).alias("length_m"), F.round("bearing_deg", 3).alias("bearing_deg"))


@query("sample_points", compose("""
    SELECT (sample_start + i)::BIGINT AS sample_id, no::BIGINT AS edge_id, round(i / (sample_count - 1), 6) AS t,
           round(ax + (bx - ax) * i / (sample_count - 1), 4) AS x_m, round(ay + (yb - ay) * i / (sample_count - 1), 4) AS y_m
    FROM (SELECT *, unnest(range(0, sample_count)) AS i FROM numbered)""", "numbered", extra=STREETS))
def sample_points(spark, sf):
    return GR.sample_points(numbered_edges(spark, sf)).select(
        "sample_id", "edge_id", F.round("t", 6).alias("t"), F.round("x_m", 4).alias("x_m"), F.round("y_m", 4).alias("y_m"))


@query("contiguous_ids", compose("""
    SELECT no::BIGINT AS edge_id, u::BIGINT AS u, v::BIGINT AS v, sample_start::BIGINT AS sample_start, sample_count::BIGINT AS sample_count FROM numbered""", "numbered", extra=STREETS))
def contiguous_ids(spark, sf):
    return numbered_edges(spark, sf).select("edge_id", "u", "v", "sample_start", F.col("sample_count").cast("long").alias("sample_count"))


@query("bearing", compose("SELECT edge_id::BIGINT AS edge_id, round(bearing_deg, 4) AS bearing_deg FROM edges", "edges"))
def bearing(spark, sf):
    return city.edges(spark, sf).select("edge_id", F.round("bearing_deg", 4).alias("bearing_deg"))


@query("street_span", compose("""
    SELECT a.physical_id::BIGINT AS physical_id, round(sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)), 4) AS span_m
    FROM sidewalks a JOIN sidewalks b USING (physical_id) WHERE a.side = 0 AND b.side = 1""", "sidewalks", extra=STREETS))
def street_span(spark, sf):
    return GR.street_spans(built_graph(spark, sf)[1]).select("physical_id", F.round("span_m", 4).alias("span_m"))


@query("width_hint", compose("""
    SELECT edge_id::BIGINT AS edge_id, round(least(12, greatest(1.5, 2 * (4 - gap) + 4)), 5) AS width_m FROM (
      SELECT e.edge_id, min(abs(CASE WHEN e.dir THEN e.mx - (300000 + 80 * s.col + 11) ELSE e.my - (64000 + 80 * s.row + 11) END)) AS gap
      FROM (SELECT edge_id, (ax + bx) / 2 AS mx, (ay + yb) / 2 AS my, ax = bx AS dir, kind FROM edges) e
      LEFT JOIN (SELECT DISTINCT col, row, dir FROM blocks) s ON s.dir = 0 AND NOT e.dir AND e.kind = 0
        AND e.mx BETWEEN 300000 + 80 * s.col AND 300000 + 80 * s.col + 80 AND abs(e.my - (64000 + 80 * s.row + 11)) <= 12
      WHERE e.kind = 0 AND NOT e.dir GROUP BY 1)""", "edges", "blocks"))
def width_hint(spark, sf):
    """Surveyed lines run eleven metres north of every east-west centreline."""
    b = city.blocks(spark, sf).filter("dir = 0")
    x, y = F.lit(city.X0) + F.col("col") * 80.0, F.lit(city.Y0) + F.col("row") * 80.0 + 11.0
    lines = b.select(x.alias("ax"), y.alias("ay"), (x + 80.0).alias("bx"), y.alias("by"))
    east = city.edges(spark, sf).filter((F.col("kind") == 0) & (F.col("path")[0]["y"] == F.col("path")[1]["y"]))
    return GR.width_hint(east, lines).select("edge_id", F.round("width_m", 5).alias("width_m"))


@query("arcs", compose("""
    SELECT edge_id::BIGINT AS edge_id, u::BIGINT AS from_node, v::BIGINT AS to_node FROM edges
    UNION ALL SELECT edge_id, v, u FROM edges""", "edges"))
def arcs(spark, sf):
    return GR.arcs(city.edges(spark, sf)).select("edge_id", "from_node", "to_node")


@query("degree", compose("""
    SELECT node_id::BIGINT AS node_id, count(*)::BIGINT AS degree FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1""", "edges"))
def degree(spark, sf):
    return GR.degree(city.edges(spark, sf))


@query("node_lookup", compose("""
    SELECT edge_id::BIGINT AS edge_id, node_id::BIGINT AS node_id, x_m, y_m FROM (SELECT edge_id, u AS node_id FROM edges) JOIN nodes USING (node_id)""", "edges", "nodes"))
def node_lookup(spark, sf):
    rows = city.edges(spark, sf).select("edge_id", F.col("u").alias("node_id"))
    return GR.node_lookup(rows, city.nodes(spark, sf, geographic=False)).select("edge_id", "node_id", "x_m", "y_m")


# ---- scene -----------------------------------------------------------------

@query("build_prisms", compose("""
    SELECT building_id::BIGINT AS building_id, height_m, base_m, bx0, by0, bx1, by1 FROM buildings""", "buildings"))
def build_prisms(spark, sf):
    from ..operators.scene import build_prisms as prisms, footprint_bounds
    raw = city.buildings(spark, sf).withColumnRenamed("building_id", "order_no")
    return footprint_bounds(prisms(raw, ["order_no"])).select("building_id", "height_m", "base_m", "bx0", "by0", "bx1", "by1")


@query("build_crowns", compose("""
    SELECT tree_id::BIGINT AS tree_id, dbh_cm, round(crown_radius_m, 5) AS crown_radius_m, round(crown_base_m, 5) AS crown_base_m,
           round(crown_top_m, 5) AS crown_top_m, tau, tau_source FROM trees""", "trees"))
def crowns(spark, sf):
    raw = city.tree_points(spark, sf).withColumnRenamed("tree_id", "order_no")
    out = build_crowns(raw, ["order_no"])
    return out.select("tree_id", "dbh_cm", *[F.round(c, 5).alias(c) for c in ("crown_radius_m", "crown_base_m", "crown_top_m")], "tau", "tau_source")


@query("species_tau", compose("SELECT species, tau, count(*)::BIGINT AS n FROM trees GROUP BY 1, 2", "trees"))
def tau_by_species(spark, sf):
    return species_tau(city.tree_points(spark, sf)).groupBy("species", "tau").agg(F.count(F.lit(1)).alias("n"))


# ---- checks ----------------------------------------------------------------

@query("components", compose("""
    SELECT node_id::BIGINT AS node_id, min(node_id) OVER (PARTITION BY borough)::BIGINT AS component FROM nodes""", "nodes"))
def connected_components(spark, sf):
    return components(city.edges(spark, sf).select("u", "v"), city.nodes(spark, sf, geographic=False))


@query("connectivity_by_borough", compose("""
    SELECT borough, count(*)::BIGINT AS n_nodes, 1::BIGINT AS n_components, 1.0::DOUBLE AS largest_fraction FROM nodes GROUP BY 1""", "nodes"))
def connectivity_by_borough(spark, sf):
    return K.connectivity_by_borough(city.nodes(spark, sf, geographic=False), city.edges(spark, sf))


@query("connectivity_report", compose("""
    SELECT count(*)::BIGINT AS n_components, round(max(n) / sum(n), 6) AS largest_component_fraction, 0::BIGINT AS orphan_nodes
    FROM (SELECT count(*) AS n FROM nodes GROUP BY borough)""", "nodes"))
def connectivity_report(spark, sf):
    out = K.connectivity_report(city.nodes(spark, sf, geographic=False), city.edges(spark, sf))
    return out.withColumn("largest_component_fraction", F.round("largest_component_fraction", 6))


@query("schema_check", "SELECT 'schemas' AS check_name, true AS ok, 'hard' AS level, 'all six conform' AS detail FROM customer LIMIT 1")
def schema_check(spark, sf):
    return K.schema_check(city_tables(spark, sf))


CHECK = "SELECT '{0}' AS check_name, {1} AS ok, '{2}' AS level, {3} AS detail FROM {4}"


@query("network_nonempty", compose(CHECK.format("network_nonempty", "true", "hard",
       "printf('nodes=%d, edges=%d, samples=%d', (SELECT count(*) FROM nodes), (SELECT count(*) FROM edges), (SELECT count(*) FROM samples))", "grid"), "nodes", "samples"))
def network_nonempty(spark, sf):
    return K.network_nonempty(*[city_table(spark, sf, n) for n in ("nodes", "edges", "samples")])


@query("row_index_ids", compose(CHECK.format("row_index_ids", "count(*) = max(no) + 1", "hard", "'ids match their row indices'", "numbered"), "numbered", extra=STREETS))
def row_index_ids(spark, sf):
    return K.row_index_ids(*[city_table(spark, sf, n) for n in ("nodes", "edges", "samples")])


@query("dangling_endpoints", compose("""
    SELECT DISTINCT node_id::BIGINT AS node_id FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges)
    WHERE node_id NOT IN (SELECT node_id FROM nodes WHERE borough = '1')""", "edges", "nodes"))
def dangling_endpoints(spark, sf):
    """Ends that a build of borough 1 alone would leave dangling."""
    return K.dangling_endpoints(city.nodes(spark, sf, geographic=False).filter("borough = '1'"), city.edges(spark, sf))


@query("both_sides_present", compose(CHECK.format("both_sides_present", "count_if(n <> 2) = 0", "hard",
       "printf('%d of %d streets lack a left/right pair', count_if(n <> 2)::BIGINT, count(*))",
       "(SELECT physical_id, count(DISTINCT side) AS n FROM edges WHERE kind = 0 GROUP BY 1)"), "edges"))
def both_sides_present(spark, sf):
    return K.both_sides_present(city_table(spark, sf, "edges"))


@query("sample_tiling", compose(CHECK.format("sample_tiling", "true", "hard",
       "printf('%d/%d samples claimed, 0 overlaps, 0 invalid blocks, 0 wrong owners', sum(sample_count)::BIGINT, (SELECT count(*) FROM samples))", "numbered"),
       "numbered", "samples", extra=STREETS))
def sample_tiling(spark, sf):
    return K.sample_tiling(city_table(spark, sf, "edges"), city_table(spark, sf, "samples"))


@query("crossing_spans", compose(CHECK.format("crossing_spans", "max(length_m) <= 40.01", "hard",
       "printf('%d crossings, longest %.1f m, %d over limit', count(*), max(length_m), count_if(length_m > 40.01)::BIGINT)", "edges WHERE kind = 1"), "edges"))
def crossing_spans(spark, sf):
    return K.crossing_spans(city_table(spark, sf, "edges"))


@query("tau_tiers", compose("""
    SELECT 'tau_sourced' AS check_name, g / n < 0.15 AS ok, 'soft' AS level, printf('%d species, %d genus, %d global of %d', n - g - e, e, g, n) AS detail
    FROM (SELECT count(*)::BIGINT AS n, count_if(tau_source LIKE 'global default%')::BIGINT AS g, count_if(tau_source LIKE 'genus default%')::BIGINT AS e FROM trees)""", "trees"))
def tau_tiers(spark, sf):
    return K.tau_tiers(city_table(spark, sf, "trees"))


@query("offsets_share", compose(CHECK.format("offsets_from_streetwidth", "avg(v) >= 0.8", "soft", "printf('%.4f of streets got their own offset', avg(v))",
       "(SELECT CASE WHEN abs(sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)) - 12) > 0.5 THEN 1.0 ELSE 0.0 END AS v FROM sidewalks a JOIN sidewalks b USING (physical_id) WHERE a.side = 0 AND b.side = 1)"),
       "sidewalks", extra=STREETS))
def offsets_share(spark, sf):
    return K.offsets_share(built_graph(spark, sf)[1])


@query("height_stats", compose(CHECK.format("building_heights", "max(height_m) > 30", "soft",
       "printf('n=%d p50=%.1f m p99=%.2f m max=%.1f m', count(*), quantile_cont(height_m, 0.5), quantile_cont(height_m, 0.99), max(height_m))", "buildings"), "buildings"))
def height_stats(spark, sf):
    return K.height_stats(city_table(spark, sf, "buildings"))


@query("horizon_size", compose(CHECK.format("horizon_size", "count(*) * 216 < 2147483648", "soft", "printf('%d samples, %d bytes', count(*), count(*) * 216)", "samples"), "samples"))
def horizon_size(spark, sf):
    return K.horizon_size(city_table(spark, sf, "samples"))


@query("check_report")
def check_report(spark, sf):
    return K.check_report(city_tables(spark, sf))


# ---- tables at rest --------------------------------------------------------

@query("city_roundtrip", compose("""
    SELECT 'nodes' AS table_name, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL
    SELECT 'samples', count(*) FROM samples UNION ALL SELECT 'buildings', count(*) FROM buildings UNION ALL
    SELECT 'trees', count(*) FROM trees UNION ALL SELECT 'amenities', count(*) FROM amenities""", "nodes", "samples", "buildings", "trees", "amenities"))
def city_roundtrip(spark, sf):
    from ..session import checkpoint_root
    root = f"{checkpoint_root(spark)}/city-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    T.write_city(city_tables(spark, sf), root)
    out = None
    for name in T.CITY_TABLES:
        part = T.read_city_table(spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("source_fingerprint")
def source_fingerprint(spark, sf):
    return T.source_fingerprint({name: city_table(spark, sf, name) for name in T.FINGERPRINTED})


@query("horizon_store", compose("SELECT count(*)::BIGINT AS n, true AS fresh_is_read, true AS stale_is_refused FROM samples", "samples"))
def horizon_store(spark, sf):
    from ..session import checkpoint_root
    path = f"{checkpoint_root(spark)}/horizon-store-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    mark = source_fingerprint(spark, sf).first()["fingerprint"]
    T.write_horizon(horizon_table(spark, sf), mark, path)
    samples = city.samples(spark, sf).select("sample_id")
    fresh, stale = T.read_horizon(spark, path, mark, samples), T.read_horizon(spark, path, "other", samples)
    return fresh.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(fresh is not None).alias("fresh_is_read"), F.lit(stale is None).alias("stale_is_refused"))


@query("verify_city", compose("""
    SELECT 'tables_present' AS gate, true AS ok, '' AS detail FROM grid UNION ALL
    SELECT 'enough_edges', count(*) >= 500, printf('%d edges', count(*)) FROM edges UNION ALL
    SELECT 'horizon_matches', true, '0 samples without horizon, 0 horizons without sample, 0 misshapen' FROM grid""", "edges"))
def verify_city(spark, sf):
    tables = {**city_tables(spark, sf), "samples": city.samples(spark, sf), "edges": city.edges(spark, sf)}
    return T.verify_city(tables, horizon_table(spark, sf), min_edges=500)
