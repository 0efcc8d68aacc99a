"""The whole ETL: landed feeds -> the six tables of a city, as one version of a city folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geometry import wkb_to_line
from ..functions.projection import to_degrees, to_metres
from ..operators.graph import add_crossings, sample_points, sidewalk_edges, with_sample_blocks
from ..operators.numbering import contiguous_ids
from ..operators.parks import boundary_points, park_entrances, thin_gates
from ..operators.scene import build_crowns, build_prisms
from ..session import materialize
from . import feeds as R
from .city_store import read_version, write_version


@dataclass(frozen=True)
class CityFeeds:
    """Paths of landed feeds. `collection` says that a file is one FeatureCollection, else one feature per line."""

    streets: str
    buildings: dict[str, str]
    trees: str
    fountains: str | None = None
    cooling: list[str] = field(default_factory=list)
    parks: str | None = None
    collection: bool = False


def _to_the_millimetre(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Order columns that do not hang on the last bits of a projection."""
    return rows.withColumns({"_x": F.round("x_m", 3), "_y": F.round("y_m", 3)}), ["_x", "_y"]


def park_gates(spark: SparkSession, path: str, scope: str, edges: DataFrame, collection: bool = False, limit: int | None = None) -> DataFrame:
    """(name, x_m, y_m, lon, lat) of the gates of every park, found against the walking network's own lines."""
    parks = R.read_parks(spark, path, scope, collection)
    gates = thin_gates(park_entrances(boundary_points(parks), edges), limit=limit)
    names = parks.select("park_id", "park_name").distinct()
    named = gates.join(names, "park_id")
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    return named.select(F.concat("park_name", F.lit(" entrance")).alias("name"), "x_m", "y_m", lon.alias("lon"), lat.alias("lat"))


def build_amenities(spark: SparkSession, feeds: CityFeeds, scope: str, edges: DataFrame, gates_per_park: int | None = None) -> DataFrame:
    """The amenities table: fountains, cooling sites and park gates strictly inside the scope.

    Each feed chooses its own name column. Feeds that are not given add nothing. Gates need `edges` with their paths;
    `gates_per_park` spreads at most so many round a park. Ids follow kind, name and place.
    """
    places = [R.read_places(spark, p, kind, whole_file=feeds.collection)
              for kind, paths in ((C.AMENITY_FOUNTAIN, [feeds.fountains]), (C.AMENITY_COOLING, feeds.cooling)) for p in paths if p]
    if feeds.parks:
        gates = park_gates(spark, feeds.parks, scope, edges, feeds.collection, gates_per_park)
        places.append(gates.select(F.lit(C.AMENITY_PARK).cast("short").alias("kind"), "name", "lon", "lat"))
    rows = spark.createDataFrame([], "kind short, name string, lon double, lat double")
    for part in places:
        rows = rows.unionByName(part)
    ordered, place = _to_the_millimetre(R.in_scope(rows, scope))
    return contiguous_ids(ordered, "amenity_id", ["kind", "name", *place]).drop(*place)


def build_tables(spark: SparkSession, feeds: CityFeeds, scope: str, gates_per_park: int | None = None) -> dict[str, DataFrame]:
    """Streets -> sidewalks -> crossings -> samples, footprints -> prisms, trees -> crowns, then the amenities.

    Lengths take the table's precision before they are cut into samples, so the stored length explains the sample count.
    """
    nodes, sides = sidewalk_edges(R.read_streets(spark, feeds.streets, scope, feeds.collection))
    edges = add_crossings(nodes, materialize(sides, "sidewalks"))
    edges = materialize(with_sample_blocks(edges.withColumn("length_m", F.col("length_m").cast("float"))), "edges")
    land = {"ground_albedo": F.lit(C.DEFAULT_ALBEDO), "landcover_class": F.lit(C.DEFAULT_LANDCOVER_CLASS)}
    footprints = R.read_buildings(spark, feeds.buildings, scope, feeds.collection)
    footprints = footprints.withColumns({"_x": F.round(F.col("rings")[0][0]["x"], 3), "_y": F.round(F.col("rings")[0][0]["y"], 3)})
    trees, place = _to_the_millimetre(R.read_trees(spark, feeds.trees, scope, feeds.collection))
    lon, lat = to_degrees(F.col("x_m"), F.col("y_m"))
    return {
        "nodes": nodes.withColumns({"lon": lon, "lat": lat, "is_intersection": F.lit(True)}),
        "edges": edges,
        "samples": sample_points(edges).withColumns(land),
        "buildings": build_prisms(footprints, ["borough", "bin", "_x", "_y", "height_m"]),
        "trees": build_crowns(trees, [*place, "species", "dbh_cm"]),
        "amenities": build_amenities(spark, feeds, scope, edges, gates_per_park),
    }


def build_city(spark: SparkSession, feeds: CityFeeds, scope: str, root: str, build_id: str, gates_per_park: int | None = None) -> int:
    """Build all six tables and commit them as the next version of the folder; returns the version."""
    return write_version(spark, root, build_id, build_tables(spark, feeds, scope, gates_per_park))


def rebuild_amenities_only(spark: SparkSession, feeds: CityFeeds, scope: str, root: str, build_id: str, gates_per_park: int | None = None) -> int:
    """A version with new amenities, found against the edges of the version before, whose other tables it shares.

    Nothing is keyed by amenities, so ids of edges and samples and all horizons stay as they are.
    """
    edges = read_version(spark, root, "edges").withColumn("path", wkb_to_line("geom_wkb"))
    return write_version(spark, root, build_id, {"amenities": build_amenities(spark, feeds, scope, edges, gates_per_park)})
