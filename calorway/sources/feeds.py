"""City open-data feeds -> typed, filtered rows in metres.

Every reader takes landed files. Filters on plain columns come first, geometry
is parsed only for what is left.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import geometry as G
from ..functions.projection import box_to_metres, to_degrees, to_metres
from ..operators.numbering import contiguous_ids
from ..operators.weather import FALLBACK
from .geojson import line_parts, path_meets_box, polygon_parts, project_path, read_features

STREET_PROPERTIES = ["physicalid", "full_street_name", "boroughcode", "rw_type", "streetwidth"]
BUILDING_PROPERTIES = ["bin", "height_roof", "ground_elevation", "feature_code"]
TREE_PROPERTIES = ["longitude", "latitude", "borocode", "status", "tree_dbh", "spc_latin"]
PARK_PROPERTIES = ["class", "typecategory", "acres", *C.PARK_NAME_COLUMNS]


def _number(name: str) -> Column:
    return F.expr(f"try_cast({name} AS double)")


def title_case(name: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere; null becomes ''."""
    low = F.lower(F.coalesce(name, F.lit("")))
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    capped = F.transform(letters, lambda c, i: F.when(
        (i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.array_join(capped, "")


def exclude_islands(streets: DataFrame) -> DataFrame:
    """Drops lines whose middle lies in one of the fixed island boxes, edges included."""
    mid = G.interpolate(F.col("path"), G.path_length(F.col("path")) / 2.0)
    # bound to a name, the middle and its degrees are computed once a row; as columns the filter would repeat them in every comparison
    def degrees(m):
        lon, lat = to_degrees(m["x"], m["y"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    def on_island(p):
        return reduce(or_, [p["lon"].between(w, e) & p["lat"].between(s, n) for w, s, e, n in C.ISLAND_BOXES])

    return streets.filter(~F.exists(F.transform(F.array(mid), degrees), on_island))


def read_streets(spark: SparkSession, paths, scope: str, collection: bool = False) -> DataFrame:
    """(seq, physical_id, street_name, borough, street_width_m, path) of walkable lines in scope; seq is unique per line part."""
    boroughs, box = C.SCOPES[scope]
    rows = read_features(spark, paths, STREET_PROPERTIES, collection)
    # a feed without the column keeps all rows
    typed = rows.filter(F.col("boroughcode").isin(*boroughs) & (
        F.col("rw_type").isNull() | F.col("rw_type").isin(*C.WALKABLE_ROAD_TYPES)))
    parts = line_parts(typed).filter(path_meets_box(F.col("path"), *box))
    parts = exclude_islands(parts.withColumn("path", project_path(F.col("path"))))
    width = F.expr("try_cast(streetwidth AS double)") * C.FEET_TO_M
    physical = F.col("physicalid").cast("long")
    typed = parts.select(physical.alias("physical_id"), title_case(F.col("full_street_name")).alias("street_name"),
                         F.col("boroughcode").alias("borough"), width.alias("street_width_m"), "path", "part", F.xxhash64("path").alias("_shape"))
    # ids repeat and may be null, so every part is numbered by itself
    return contiguous_ids(typed, "seq", ["physical_id", "part", "_shape"]).drop("part", "_shape")


def read_buildings(spark: SparkSession, by_borough: dict[str, str], scope: str, collection: bool = False) -> DataFrame:
    """(height_m, base_m, rings, borough) of usable footprints; every borough of the scope must have a feed."""
    boroughs, box = C.SCOPES[scope]
    unknown = [b for b in boroughs if b not in C.KNOWN_BOROUGHS]
    missing = [b for b in boroughs if b not in by_borough]
    if unknown or missing:
        raise ValueError(f"no building feed for boroughs {unknown + missing}")
    rows = None
    for b in boroughs:
        part = read_features(spark, by_borough[b], BUILDING_PROPERTIES, collection).withColumn("borough", F.lit(b))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.filter(F.col("feature_code").isNull() | F.col("feature_code").isin(*C.BUILDING_FEATURE_CODES))
    rows = rows.withColumn("height_m", _number("height_roof") * C.FEET_TO_M).filter(F.col("height_m") >= C.MIN_BUILDING_HEIGHT_M)
    rows = rows.withColumn("base_m", F.coalesce(_number("ground_elevation"), F.lit(0.0)) * C.FEET_TO_M)
    parts = polygon_parts(rows).withColumn("rings", F.transform("rings", project_path))
    parts = parts.filter(F.forall("rings", lambda r: r[0] == F.element_at(r, -1)) & (G.ring_area(F.col("rings")[0]) != 0.0)
                         & F.forall("rings", G.ring_is_simple))
    # one projected box for the whole scope
    x0, y0, x1, y1 = box_to_metres(*box)
    bx0, by0, bx1, by1 = G.bounds(F.col("rings")[0])
    return parts.filter((bx0 <= x1) & (bx1 >= x0) & (by0 <= y1) & (by1 >= y0)).select("bin", "borough", "height_m", "base_m", "rings")


def read_trees(spark: SparkSession, paths, scope: str, collection: bool = False) -> DataFrame:
    """(x_m, y_m, species, dbh_cm, borough) of living trees; points come from the coordinate columns."""
    boroughs, (west, south, east, north) = C.SCOPES[scope]
    rows = read_features(spark, paths, TREE_PROPERTIES, collection)
    lon, lat = _number("longitude"), _number("latitude")
    kept = rows.filter((F.col("status").isNull() | (F.col("status") == "Alive")) & F.col("borocode").isin(*boroughs)
                       & lon.between(west, east) & lat.between(south, north))
    x, y = to_metres(lon, lat)
    dbh = F.least(F.greatest(_number("tree_dbh"), F.lit(0.0)), F.lit(C.MAX_DBH_IN)) * C.INCH_TO_CM
    dbh = F.when(_number("tree_dbh").isNotNull(), dbh)
    return kept.select(x.alias("x_m"), y.alias("y_m"), F.coalesce("spc_latin", F.lit("")).alias("species"),
                       dbh.alias("dbh_cm"), F.col("borocode").alias("borough"))


def read_places(spark: SparkSession, paths, kind: int, whole_file: bool = False) -> DataFrame:
    """(kind, name, lon, lat) from features, or from bare objects whose x and y are lon and lat.

    One object per line, or with whole_file one FeatureCollection or bare array per file.

    The name comes from the first candidate column that holds any text in this source.
    """
    names = list(C.PLACE_NAME_COLUMNS)
    texts = [T.StructField(n, T.StringType()) for n in [*names, "longitude", "latitude", "x", "y"]]
    geometry = T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    item = T.StructType([*texts, T.StructField("properties", T.StructType(texts)), T.StructField("geometry", geometry)])
    whole = T.StructType([*item.fields, T.StructField("features", T.ArrayType(item))])
    raw = spark.read.schema(whole).json(paths, multiLine=whole_file)
    itself = F.struct(*[F.col(f.name) for f in item.fields])
    rows = raw.select(F.explode(F.coalesce("features", F.array(itself))).alias("f")).select("f.*")

    def pick(n):
        return F.coalesce(F.col(f"properties.{n}"), F.col(n))
    rows = rows.select(*[pick(n).alias(n) for n in [*names, "longitude", "latitude", "x", "y"]], "geometry")
    # one row: which columns hold text anywhere in the source
    used = rows.agg(*[F.coalesce(F.bool_or(F.length(F.trim(n)) > 0), F.lit(False)).alias(f"_{n}") for n in names])
    rows = rows.crossJoin(F.broadcast(used))
    name = F.coalesce(*[F.when(F.col(f"_{n}"), F.coalesce(F.trim(n), F.lit(""))) for n in names], F.lit(""))
    lon = F.coalesce(F.col("geometry.coordinates")[0], _number("longitude"), _number("x"))
    lat = F.coalesce(F.col("geometry.coordinates")[1], _number("latitude"), _number("y"))
    return rows.select(F.lit(kind).cast("short").alias("kind"), name.alias("name"), lon.alias("lon"), lat.alias("lat")).filter(
        "lon IS NOT NULL AND lat IS NOT NULL")


def in_scope(places: DataFrame, scope: str) -> DataFrame:
    """Strictly inside the scope's box, with projected coordinates."""
    _, (west, south, east, north) = C.SCOPES[scope]
    kept = places.filter((F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north))
    x, y = to_metres(F.col("lon"), F.col("lat"))
    return kept.withColumns({"x_m": x, "y_m": y})


def filter_parks(parks: DataFrame) -> DataFrame:
    """Places one would walk into: by class, category and size. Absent columns do not filter."""
    acres = F.expr("try_cast(nullif(regexp_replace(acres, ',', ''), '') AS double)")
    return parks.filter(
        (F.upper(F.coalesce("class", F.lit(""))).isin(*C.PARK_CLASSES))
        & ~F.coalesce("typecategory", F.lit("")).isin(*C.PARK_EXCLUDED_CATEGORIES)
        & (F.coalesce(acres, F.lit(0.0)) >= C.MIN_PARK_ACRES))


def park_label(*names: str) -> Column:
    """First text among the name columns of the row."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit("Park"))


def read_parks(spark: SparkSession, paths, scope: str, collection: bool = False) -> DataFrame:
    """(park_id, park_name, part, rings) in scope, one row per polygon; empty when the feed is absent.

    park_id numbers the features by name and outline, so the parts of one park share it.
    """
    _, box = C.SCOPES[scope]
    try:
        rows = read_features(spark, paths, PARK_PROPERTIES, collection)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], "park_id long, park_name string, part int, rings array<array<struct<x:double,y:double>>>")
    named = filter_parks(rows).withColumn("park_name", park_label(*C.PARK_NAME_COLUMNS)).drop(*PARK_PROPERTIES)
    numbered = contiguous_ids(named, "park_id", ["park_name", "coordinates"])
    parts = polygon_parts(numbered).filter(path_meets_box(F.col("rings")[0], *box))
    return parts.select("park_id", "park_name", "part", F.transform("rings", project_path).alias("rings"))


def read_weather_hours(spark: SparkSession, paths, whole_file: bool = False) -> DataFrame:
    """One row per hour from payloads of parallel arrays; wind becomes m/s.

    One payload per line, or with whole_file one per file.

    Stamps are New York clock time, whatever the session's zone; of a stamp that
    follows itself, as in the autumn change, the second is an hour later. A payload without hours gives the labelled
    fallback row at no particular hour.
    """
    kmh = 1.0 / 3.6
    fields = {"temperature_2m": "air_temp_c", "relative_humidity_2m": "relative_humidity_pct",
              "wind_speed_10m": "wind_speed_10m_ms", "cloud_cover": "cloud_cover_pct",
              "direct_normal_irradiance": "direct_normal_wm2", "diffuse_radiation": "diffuse_wm2",
              "shortwave_radiation": "global_horizontal_wm2", "uv_index": "uv_index"}
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))]
                          + [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])
    raw = spark.read.schema(T.StructType([T.StructField("hourly", hourly)])).json(paths, multiLine=whole_file)
    zipped = F.arrays_zip(*[F.col(f"hourly.{f}") for f in ["time", *fields]])
    stamps = F.col("hourly.time")
    again = F.transform(stamps, lambda t, i: F.coalesce(F.get(stamps, i - 1) == t, F.lit(False)))
    rows = raw.select(F.explode_outer(F.zip_with(zipped, again, lambda h, a: F.struct(h.alias("h"), a.alias("again")))).alias("r")).select("r.h", "r.again")
    rows = rows.withColumn("utc", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.to_timestamp_ntz("h.time", F.lit("yyyy-MM-dd'T'HH:mm"))))
    # counted from calendar fields, which no session zone moves
    epoch = F.datediff(F.to_date("utc"), F.lit("1970-01-01")).cast("long") * 86_400 + F.hour("utc") * 3600 + F.minute("utc") * 60
    out = rows.select((epoch + F.when(F.col("again"), 3600).otherwise(0)).alias("hour_s"), *[F.col(f"h.{f}").alias(n) for f, n in fields.items()])
    out = out.withColumn("wind_speed_10m_ms", F.col("wind_speed_10m_ms") * kmh)
    known = F.col("hour_s").isNotNull()
    filled = {n: F.when(known, F.col(n)).otherwise(F.lit(FALLBACK[n])) for n in fields.values()}
    return out.withColumns({**filled, "source": F.when(known, "feed").otherwise(F.lit(FALLBACK["source"]))})
