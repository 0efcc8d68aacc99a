"""Whole builds from landed feeds, committed as versions of a city folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.geometry import wkb_to_line, wkb_to_rings
from ..schemas import CITY_TABLES
from ..session import checkpoint_root
from ..sources import city_store as S
from ..sources import feeds as R
from ..sources.city_build import CityFeeds, build_city, rebuild_amenities_only
from . import derived_city as city
from .graph_queries import CROSSINGS, STREETS, recursive
from .map_queries import FEEDS, ISLANDS, PARKS, building_feeds, feed_path, ll_sql, park_outlines, place_feeds, street_feed, tree_feed, _degree_pairs
from .oracle import CTES, compose
from .registry import query

SCOPE = "manhattan_brooklyn"
_BUILT: dict[tuple, str] = {}


def park_feed(spark, sf):
    """Parks as multi-part features: every fifth is of another class, every fourth has no name."""
    k = F.col("park_id")
    props = F.struct(F.when(k % 5 == 4, "LOT").otherwise("Park").alias("class"), F.lit("Garden").alias("typecategory"), F.lit("1,200.5").alias("acres"),
                     F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("Green "), k)).alias("signname"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.transform("rings", _degree_pairs)).alias("coordinates"))
    rows = park_outlines(spark, sf).select(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))
    return feed_path(spark, sf, "parks", rows)


def city_feeds(spark, sf):
    fountains, cooling = place_feeds(spark, sf)
    return CityFeeds(street_feed(spark, sf), building_feeds(spark, sf), tree_feed(spark, sf), fountains, [cooling], park_feed(spark, sf))


def built_root(spark, sf):
    """A city folder whose first version was built from all feeds, once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        root = f"{checkpoint_root(spark)}/cities/{uuid.uuid4().hex}"
        build_city(spark, city_feeds(spark, sf), SCOPE, root, "build-1")
        _BUILT[key] = root
    return _BUILT[key]


def _rows(name, id_column, longs, text, numbers):
    """One shape for the rows of all tables."""
    names = ["k1", "k2", "k3"]
    longs = [F.col(c).cast("long") if isinstance(c, str) else c for c in longs] + [F.lit(None).cast("long")] * (3 - len(longs))
    values = [F.round(F.col(c) if isinstance(c, str) else c, 3).cast("double").alias(f"v{i + 1}") for i, c in enumerate(numbers)]
    return [F.lit(name).alias("table_name"), F.col(id_column).cast("long").alias("id"), *[c.alias(n) for c, n in zip(longs, names)], text.alias("label"), *values]


def all_rows(spark, root, version=None):
    t = {n: S.read_version(spark, root, n, version) for n in CITY_TABLES}
    mid = wkb_to_line("geom_wkb")[1]
    corner = wkb_to_rings("geom_wkb")[0][0]
    parts = [
        t["nodes"].select(*_rows("nodes", "node_id", [], F.col("borough"), ["x_m", "y_m", "lon", "lat"])),
        t["edges"].withColumn("_p", mid).select(*_rows("edges", "edge_id", ["u", "v", "physical_id"], F.concat_ws("|", "street_name", "kind", "side", "sample_start", "sample_count"),
                                                       ["length_m", F.round("bearing_deg", 3) % 360, F.col("_p.x"), F.col("_p.y")])),
        t["samples"].select(*_rows("samples", "sample_id", ["edge_id", "landcover_class"], F.lit(""), ["x_m", "y_m", "t", "ground_albedo"])),
        t["buildings"].withColumn("_p", corner).select(*_rows("buildings", "building_id", [], F.lit(""), ["height_m", "base_m", F.col("_p.x"), F.col("_p.y")])),
        t["trees"].select(*_rows("trees", "tree_id", [], F.concat_ws("|", "species", "tau_source"), ["x_m", "y_m", "crown_radius_m", "tau"])),
        t["amenities"].select(*_rows("amenities", "amenity_id", ["kind"], F.col("name"), ["x_m", "y_m", "lon", "lat"]))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# the same build in SQL: streets and trees that pass the feeds' filters, then the rules of the graph
BUILD = {
    **FEEDS, **PARKS, **CROSSINGS,
    "all_streets": STREETS["streets"],
    "mids": (("all_streets",), FEEDS["mids"][1].replace("FROM streets", "FROM all_streets")),
    "streets": (("mids_ll",), f"SELECT * EXCLUDE (mx, my, lon, lat) FROM mids_ll WHERE seq % 4 <> 2 AND NOT ({ISLANDS})"),
    "g_nodes_ll": (("g_nodes", "lcc"), ll_sql("g_nodes")),
    "all_trees": CTES["tree_points"],
    "tree_ll": (("all_trees", "lcc"), ll_sql("all_trees")),
    "tree_points": (("tree_ll",), """
        SELECT * REPLACE (least(raw_dbh * 2, 60) * 2.54 AS raw_dbh) FROM tree_ll
        WHERE tree_id % 9 <> 0 AND tree_id % 5 <> 4 AND lon BETWEEN -74.05 AND -73.833 AND lat BETWEEN 40.57 AND 40.883"""),
    # park gates lie along the built network: both halves of every sidewalk, and the crossings
    "lines": (("full_edges",), """
        SELECT x0 AS ax, y0 AS ay, x1 AS bx, y1 AS yb FROM full_edges UNION ALL SELECT x1, y1, x2, y2 FROM full_edges WHERE kind = 0"""),
    "gates": (("outline", "lines"), PARKS["gates"][1].replace("FROM edges", "FROM lines").replace("FROM outline)", "FROM outline WHERE park_id % 5 <> 4)")),
    "gates_ll": (("thin", "lcc"), ll_sql("(SELECT park_id, px AS x_m, py AS y_m FROM thin WHERE took)")),
    "city_amenities": (("amenities_ll", "gates_ll"), """
        SELECT row_number() OVER (ORDER BY kind, name, round(x_m, 3), round(y_m, 3)) - 1 AS amenity_id, * FROM (
          SELECT kind, name, x_m, y_m, lon, lat FROM amenities_ll WHERE kind < 2
          UNION ALL SELECT 2, CASE WHEN park_id % 4 = 0 THEN 'Park' ELSE 'Green ' || park_id END || ' entrance', x_m, y_m, lon, lat FROM gates_ll)
        WHERE lon > -74.05 AND lon < -73.833 AND lat > 40.57 AND lat < 40.883"""),
    "city_trees": (("trees",), "SELECT row_number() OVER (ORDER BY round(x_m, 3), round(y_m, 3), species, dbh_cm) - 1 AS no, * FROM trees"),
    "city_buildings": (("buildings",), """
        SELECT row_number() OVER (ORDER BY CASE WHEN building_id % 2 = 0 THEN '1' ELSE '3' END, building_id::VARCHAR) - 1 AS no, * FROM buildings
        WHERE building_id % 11 <> 0 AND building_id % 50 <> 0"""),
}
PARTS = {
    "nodes": (("g_nodes_ll",), """
        SELECT 'nodes' AS table_name, node_id::BIGINT AS id, NULL::BIGINT AS k1, NULL::BIGINT AS k2, NULL::BIGINT AS k3, borough AS label,
               round(x_m, 3) AS v1, round(y_m, 3) AS v2, round(lon, 3) AS v3, round(lat, 3) AS v4 FROM g_nodes_ll"""),
    "edges": (("full_edges",), """
        SELECT 'edges', edge_id, u, v, physical_id, concat_ws('|', street_name, kind, side, sample_start, c), round(len, 3), round(bearing, 3) % 360, round(x1, 3), round(y1, 3) FROM full_edges"""),
    "samples": (("full_samples",), "SELECT 'samples', sample_id, edge_id, 7, NULL, '', round(x_m, 3), round(y_m, 3), round(t, 3), 0.25 FROM full_samples"),
    "buildings": (("city_buildings",), "SELECT 'buildings', no, NULL, NULL, NULL, '', round(height_m, 3), round(base_m, 3), round(bx0, 3), round(by0, 3) FROM city_buildings"),
    "trees": (("city_trees",), "SELECT 'trees', no, NULL, NULL, NULL, concat_ws('|', species, tau_source), round(x_m, 3), round(y_m, 3), round(crown_radius_m, 3), round(tau, 3) FROM city_trees"),
    "amenities": (("city_amenities",), "SELECT 'amenities', amenity_id, kind, NULL, NULL, name, round(x_m, 3), round(y_m, 3), round(lon, 3), round(lat, 3) FROM city_amenities"),
}


def rows_sql(*names: str) -> str:
    """SQL for the rows of some tables; the union takes its column names from the first."""
    header = "SELECT '' AS table_name, 0::BIGINT AS id, 0::BIGINT AS k1, 0::BIGINT AS k2, 0::BIGINT AS k3, '' AS label, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS v4 WHERE false"
    needs = [need for n in names for need in PARTS[n][0]]
    return recursive(compose(" UNION ALL ".join([header, *[PARTS[n][1] for n in names]]), *needs, extra=BUILD))


@query("build_city", rows_sql(*PARTS))
def built_city(spark, sf):
    """Every row of the six tables that a build from all feeds commits."""
    return all_rows(spark, built_root(spark, sf))


@query("rebuild_amenities_only", recursive(compose("""
    SELECT 'amenities' AS table_name, count(*)::BIGINT AS n_rows, false AS shared FROM city_amenities UNION ALL SELECT 'nodes', count(*), true FROM g_nodes
    UNION ALL SELECT 'edges', count(*), true FROM full_edges UNION ALL SELECT 'samples', sum(c)::BIGINT, true FROM full_edges
    UNION ALL SELECT 'buildings', count(*), true FROM city_buildings UNION ALL SELECT 'trees', count(*), true FROM city_trees""",
    "city_amenities", "g_nodes", "full_edges", "city_buildings", "city_trees", extra=BUILD)))
def rebuilt_amenities(spark, sf):
    """The second version's tables, and which of them are the files of the first."""
    root = f"{checkpoint_root(spark)}/cities/{uuid.uuid4().hex}"
    feeds = city_feeds(spark, sf)
    first = built_root(spark, sf)
    # a folder of its own whose first version has the built tables but no amenities yet
    tables = {n: S.read_version(spark, first, n) for n in CITY_TABLES}
    S.write_version(spark, root, "build-1", {**tables, "amenities": tables["amenities"].limit(0)})
    rebuild_amenities_only(spark, feeds, SCOPE, root, "amenities-2")
    before, now = S.manifests(spark, root).filter("version = 1"), S.manifests(spark, root).filter("version = 2")
    old = before.select("table_name", F.col("folder").alias("_old"))
    return now.join(old, "table_name").select("table_name", "n_rows", (F.col("folder") == F.col("_old")).alias("shared"))


@query("city_amenities", rows_sql("amenities"))
def city_amenities(spark, sf):
    """The amenities of a built city, row by row."""
    return all_rows(spark, built_root(spark, sf)).filter("table_name = 'amenities'")


@query("read_parks", recursive(compose("""
    SELECT CASE WHEN park_id % 4 = 0 THEN 'Park' ELSE 'Green ' || park_id END AS park_name, 0::BIGINT AS part, round(x, 3) AS x0, round(y, 3) AS y0, round(x + a, 3) AS x1, round(y + b, 3) AS y1
    FROM parks WHERE park_id % 5 <> 4""", "parks", extra=PARKS)))
def read_parks(spark, sf):
    parks = R.read_parks(spark, park_feed(spark, sf), SCOPE)
    ring = F.col("rings")[0]
    return parks.select("park_name", F.col("part").cast("long").alias("part"), F.round(ring[0]["x"], 3).alias("x0"), F.round(ring[0]["y"], 3).alias("y0"),
                        F.round(ring[2]["x"], 3).alias("x1"), F.round(ring[2]["y"], 3).alias("y1"))
