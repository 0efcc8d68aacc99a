"""GeoJSON features as DataFrames: one feature per line (splittable) or one FeatureCollection per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import segments
from ..functions.projection import to_metres

_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])


def read_features(spark: SparkSession, paths: str | list[str], properties: list[str], collection: bool = False) -> DataFrame:
    """Named properties as text (null when absent), geom_type, and coordinates as JSON text."""
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", _GEOMETRY)])
    if collection:
        whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
        rows = spark.read.schema(whole).json(paths, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    else:
        rows = spark.read.schema(feature).json(paths)
    return rows.select(*[F.col(f"properties.{p}").alias(p) for p in properties],
                       F.col("geometry.type").alias("geom_type"), F.col("geometry.coordinates").alias("coordinates"))


def _points(raw: Column) -> Column:
    return F.transform(raw, lambda c: F.named_struct(F.lit("x"), c[0], F.lit("y"), c[1]))


def line_parts(features: DataFrame) -> DataFrame:
    """One row per LineString part with at least two points, in degrees, as `path`."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geom_type") == "LineString", one).when(F.col("geom_type") == "MultiLineString", many)
    rows = features.select("*", F.posexplode(parts).alias("part", "_p")).withColumn("path", _points(F.col("_p")))
    return rows.filter(F.size("path") >= 2).drop("_p", "coordinates", "geom_type")


def polygon_parts(features: DataFrame) -> DataFrame:
    """One row per Polygon part as `rings` (outer ring first), in degrees."""
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geom_type") == "Polygon", one).when(F.col("geom_type") == "MultiPolygon", many)
    rows = features.select("*", F.posexplode(parts).alias("part", "_p"))
    rows = rows.withColumn("rings", F.transform("_p", _points)).filter(F.size("rings") > 0)
    return rows.filter(F.size(F.col("rings")[0]) >= 4).drop("_p", "coordinates", "geom_type")


def project_path(path: Column) -> Column:
    def one(p):
        x, y = to_metres(p["x"], p["y"])
        return F.named_struct(F.lit("x"), x, F.lit("y"), y)
    return F.transform(path, one)


def _segment_meets(seg: Column, west: float, south: float, east: float, north: float) -> Column:
    """Slab test of one segment against a closed box."""
    def span(a, b, low, high):
        d = b - a
        first, last = F.try_divide(F.lit(low) - a, d), F.try_divide(F.lit(high) - a, d)
        inside = a.between(low, high)
        return (F.when(d == 0.0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(first, last)),
                F.when(d == 0.0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(first, last)))
    x0, x1 = span(seg["a"]["x"], seg["b"]["x"], west, east)
    y0, y1 = span(seg["a"]["y"], seg["b"]["y"], south, north)
    return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))


def path_meets_box(path: Column, west: float, south: float, east: float, north: float) -> Column:
    """True intersection of a path with a closed box."""
    return F.exists(segments(path), lambda s: _segment_meets(s, west, south, east, north))
