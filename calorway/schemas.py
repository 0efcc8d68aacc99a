"""Explicit schemas of the six city tables and of the horizon table."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, bool(o)) for n, t, *o in fields])


NODES = _schema(
    ("node_id", T.LongType()), ("x_m", T.DoubleType()), ("y_m", T.DoubleType()),
    ("lon", T.DoubleType()), ("lat", T.DoubleType()),
    ("is_intersection", T.BooleanType()), ("borough", T.StringType()),
)
EDGES = _schema(
    ("edge_id", T.LongType()), ("u", T.LongType()), ("v", T.LongType()),
    ("kind", T.ShortType()), ("side", T.ByteType()), ("street_name", T.StringType()),
    ("physical_id", T.LongType()), ("bearing_deg", T.FloatType()), ("length_m", T.FloatType()),
    ("width_m", T.FloatType(), True), ("sample_start", T.LongType()),
    ("sample_count", T.IntegerType()), ("geom_wkb", T.BinaryType()),
)
SAMPLES = _schema(
    ("sample_id", T.LongType()), ("edge_id", T.LongType()), ("t", T.FloatType()),
    ("x_m", T.DoubleType()), ("y_m", T.DoubleType()),
    ("ground_albedo", T.FloatType()), ("landcover_class", T.ShortType()),
)
BUILDINGS = _schema(
    ("building_id", T.LongType()), ("height_m", T.FloatType()), ("base_m", T.FloatType()),
    ("geom_wkb", T.BinaryType()),
)
TREES = _schema(
    ("tree_id", T.LongType()), ("x_m", T.DoubleType()), ("y_m", T.DoubleType()),
    ("species", T.StringType()), ("dbh_cm", T.FloatType()), ("crown_radius_m", T.FloatType()),
    ("crown_base_m", T.FloatType()), ("crown_top_m", T.FloatType()),
    ("tau", T.FloatType()), ("tau_source", T.StringType()),
)
AMENITIES = _schema(
    ("amenity_id", T.LongType()), ("kind", T.ShortType()), ("name", T.StringType()),
    ("x_m", T.DoubleType()), ("y_m", T.DoubleType()), ("lon", T.DoubleType()), ("lat", T.DoubleType()),
)
CITY_TABLES = {
    "nodes": NODES, "edges": EDGES, "samples": SAMPLES,
    "buildings": BUILDINGS, "trees": TREES, "amenities": AMENITIES,
}
HORIZON = _schema(
    ("sample_id", T.LongType()), ("opaque", T.ArrayType(T.ShortType())),
    ("canopy", T.ArrayType(T.ShortType())), ("tau_q", T.ArrayType(T.ShortType())),
)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PATH = T.ArrayType(POINT)
