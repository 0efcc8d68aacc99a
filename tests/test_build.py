import json

import pytest
from pyspark.sql import functions as F

from calorway.functions.projection import to_degrees
from calorway.schemas import CITY_TABLES
from calorway.sources import city_store as S
from calorway.sources.city_build import CityFeeds, build_amenities, build_city, build_tables, rebuild_amenities_only
from calorway.sources.tables import SchemaError

X, Y, SCOPE = 301000.0, 64500.0, "midtown"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Feeds of four blocks round one crossing, as collections; places as metres from the middle."""
    folder = tmp_path_factory.mktemp("feeds")

    def degrees(points):
        rows = spark.createDataFrame([(i, X + x, Y + y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
        lon, lat = to_degrees(F.col("x"), F.col("y"))
        return [[r["lon"], r["lat"]] for r in rows.select("i", lon.alias("lon"), lat.alias("lat")).orderBy("i").collect()]

    def land(name, features):
        path = folder / f"{name}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": p, "geometry": None if g is None else {"type": g[0], "coordinates": g[1]}} for p, g in features]}))
        return str(path)

    arms = {"1": [(0, 0), (100, 0)], "2": [(0, 0), (-100, 0)], "3": [(0, 0), (0, 100)], "4": [(0, 0), (0, -100)]}
    streets = land("streets", [({"physicalid": k, "full_street_name": "MAIN ST" if k in "12" else "SIDE ST", "boroughcode": "1", "rw_type": "1", "streetwidth": "30"},
                                ("LineString", degrees(v))) for k, v in arms.items()])
    square = [(20, 20), (60, 20), (60, 60), (20, 60), (20, 20)]
    buildings = land("buildings", [({"bin": str(k), "height_roof": 100 + k, "ground_elevation": None, "feature_code": "2100"},
                                    ("Polygon", [degrees([(x * s, y * t) for x, y in square])])) for k, (s, t) in enumerate([(1, 1), (-1, 1), (1, -1)])])
    (lon, lat), = degrees([(15, 15)])
    trees = land("trees", [({"longitude": str(lon), "latitude": str(lat), "borocode": "1", "status": "Alive", "tree_dbh": d, "spc_latin": "Tilia cordata"}, None) for d in (10, 12)])
    park = [(25, 12), (95, 12), (95, 90), (25, 90), (25, 12)]
    parks = land("parks", [({"class": "PARK", "typecategory": "Garden", "acres": "2", "signname": "Square"}, ("MultiPolygon", [[degrees(park)], [degrees([(-x, -y) for x, y in park])]]))])
    fountains = land("fountains", [({"name": "Spring"}, ("Point", degrees([(10, 10)])[0])), ({"name": "Spring"}, ("Point", degrees([(9000, 9000)])[0]))])
    return CityFeeds(streets, {"1": buildings}, trees, fountains, [], parks, collection=True), fountains


@pytest.fixture(scope="module")
def built(spark, landed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("city"))
    assert build_city(spark, landed[0], SCOPE, root, "first") == 1
    return root


def rows_of(spark, root, name, version=None):
    return sorted(map(str, S.read_version(spark, root, name, version).collect()))


def test_a_build_chains_all_feeds(spark, built, landed):
    t = {n: S.read_version(spark, built, n) for n in CITY_TABLES}
    edges = t["edges"].orderBy("edge_id").collect()
    assert [r["edge_id"] for r in edges] == list(range(len(edges)))
    assert sum(r["kind"] == 0 for r in edges) == 8 and sum(r["kind"] == 1 for r in edges) > 0
    at = 0
    for r in edges:
        assert r["sample_start"] == at
        at += r["sample_count"]
    assert t["samples"].count() == at and t["buildings"].count() == 3 and t["trees"].count() == 2
    nodes = {r["node_id"] for r in t["nodes"].collect()}
    assert {r["u"] for r in edges} | {r["v"] for r in edges} <= nodes
    places = [(r["kind"], r["name"]) for r in t["amenities"].orderBy("amenity_id").collect()]
    assert places[0] == (0, "Spring") and len([p for p in places if p == (2, "Square entrance")]) == len(places) - 1 > 1
    version = S.city_version(spark, built, 1)
    assert version["build_id"] == "first" and version["rows"]["edges"] == len(edges)


def test_a_second_build_gives_the_same_tables(spark, built, landed, tmp_path):
    root = str(tmp_path / "again")
    build_city(spark, landed[0], SCOPE, root, "other")
    assert all(rows_of(spark, root, n) == rows_of(spark, built, n) for n in CITY_TABLES)


def test_only_amenities_are_rebuilt(spark, built, landed, tmp_path):
    root = str(tmp_path / "city")
    tables = {n: S.read_version(spark, built, n) for n in CITY_TABLES}
    S.write_version(spark, root, "first", tables)
    before = S.city_version(spark, root)
    feeds = CityFeeds(landed[0].streets, landed[0].buildings, landed[0].trees, None, [landed[1]], landed[0].parks, collection=True)
    assert rebuild_amenities_only(spark, feeds, SCOPE, root, "second") == 2
    now = S.city_version(spark, root)
    assert {n for n in CITY_TABLES if now["tables"][n] != before["tables"][n]} == {"amenities"}
    kinds = [r["kind"] for r in S.read_version(spark, root, "amenities").collect()]
    assert 1 in kinds and 0 not in kinds and 2 in kinds
    assert rows_of(spark, root, "amenities", 1) == rows_of(spark, built, "amenities") and rows_of(spark, root, "edges") == rows_of(spark, built, "edges")
    fewer = build_amenities(spark, feeds, SCOPE, build_tables(spark, feeds, SCOPE)["edges"], gates_per_park=2)
    assert fewer.filter("kind = 2").count() == 2


def test_a_build_that_dies_is_never_seen(spark, built, tmp_path):
    root = str(tmp_path / "city")
    tables = {n: S.read_version(spark, built, n) for n in CITY_TABLES}
    S.write_version(spark, root, "first", tables)
    # the third table fails while it is written: two tables of the build lie there without a manifest
    dies = F.udf(lambda n: 1 // 0, "string")
    broken = {**tables, "nodes": tables["nodes"].limit(1), "samples": tables["samples"].withColumn("t", dies("sample_id").cast("float"))}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        S.write_version(spark, root, "broken", broken)
    assert S.city_version(spark, root)["version"] == 1 and S.read_version(spark, root, "nodes").count() == tables["nodes"].count()
    assert spark.read.parquet(f"{root}/tables/nodes/broken").count() == 1
    # the build may run again under its id, and an id in use is refused
    assert S.write_version(spark, root, "broken", {"nodes": tables["nodes"]}) == 2
    assert S.city_version(spark, root)["tables"]["edges"] == "tables/edges/first"
    with pytest.raises(ValueError, match="in use"):
        S.write_version(spark, root, "first", tables)


def test_versions_that_are_not_there(spark, built, tmp_path):
    empty = str(tmp_path / "none")
    assert S.city_version(spark, empty) == {"version": 0, "build_id": None, "tables": {}, "rows": {}}
    with pytest.raises(LookupError):
        S.read_version(spark, empty, "nodes")
    with pytest.raises(LookupError):
        S.city_version(spark, built, 9)
    with pytest.raises(ValueError, match="missing tables"):
        S.write_version(spark, empty, "x", {"nodes": S.read_version(spark, built, "nodes")})
    with pytest.raises(SchemaError):
        S.write_version(spark, str(tmp_path / "bad"), "x", {**{n: S.read_version(spark, built, n) for n in CITY_TABLES},
                                                            "nodes": S.read_version(spark, built, "nodes").withColumn("borough", F.lit(None).cast("string"))})


def test_a_check_builds_only_the_tables_it_reads(spark, tmp_path):
    """The check on trees needs no parts, suppliers or edges."""
    from calorway.plans import catalog
    spark.createDataFrame([(k,) for k in range(16)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 16) for k in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    row = catalog.QUERIES["tau_tiers"](spark, str(tmp_path)).first()
    assert row["check_name"] == "tau_sourced" and row["detail"].endswith(" of 60")
    assert catalog.QUERIES["row_index_ids"](spark, str(tmp_path)).first()["ok"]
