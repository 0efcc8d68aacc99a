"""Raw sources -> prisms and crowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds
from .numbering import contiguous_ids

# fixed values: crown allometry and defaults
CROWN_A, CROWN_B, HEIGHT_A, HEIGHT_B = 0.55, 0.70, 1.35, 0.62
CROWN_RADIUS_MIN_M, TREE_HEIGHT_MIN_M = 0.8, 3.0
CROWN_BASE_FRACTION, CROWN_BASE_MIN_M = 0.35, 2.0
MEDIAN_DBH_CM = 23.0

# fixed values: transmissivity of the direct beam by species and by genus
SPECIES_TAU = {
    "Platanus x acerifolia": 0.10, "Gleditsia triacanthos": 0.38, "Quercus palustris": 0.12,
    "Pyrus calleryana": 0.10, "Zelkova serrata": 0.15, "Tilia cordata": 0.08,
    "Ginkgo biloba": 0.20, "Styphnolobium japonicum": 0.13, "Acer platanoides": 0.10,
    "Quercus robur": 0.12, "Prunus": 0.25, "Betula pendula": 0.25,
}
GENUS_TAU = {
    "Gleditsia": 0.38, "Platanus": 0.10, "Quercus": 0.12, "Acer": 0.10, "Tilia": 0.08,
    "Pyrus": 0.10, "Zelkova": 0.15, "Ginkgo": 0.20, "Ulmus": 0.15, "Styphnolobium": 0.13,
    "Sophora": 0.13, "Prunus": 0.25, "Betula": 0.25, "Fraxinus": 0.25, "Liquidambar": 0.10,
    "Celtis": 0.04,
}
GLOBAL_TAU = 0.18
CULTIVAR_MARKS = (" var. ", " f. ", " subsp. ", " '")


def species_key(name: Column) -> Column:
    """Species name with spaces collapsed and any cultivar suffix cut off."""
    key = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    for mark in CULTIVAR_MARKS:
        at = F.instr(key, mark)
        key = F.when(at > 1, F.substr(key, F.lit(1), at - 1)).otherwise(key)
    return F.trim(key)


def _lookup(spark, values: dict, key: str, value: str) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), f"{key} string, {value} double")


def species_tau(trees: DataFrame) -> DataFrame:
    """Adds tau and tau_source: species, then genus, then the global default.

    Both lookup tables are fixed lists of under twenty rows, so they broadcast.
    """
    spark = trees.sparkSession
    keyed = trees.withColumn("_species", species_key(F.col("species")))
    keyed = keyed.withColumn("_genus", F.substring_index("_species", " ", 1))
    keyed = keyed.join(F.broadcast(_lookup(spark, SPECIES_TAU, "_species", "_by_species")), "_species", "left")
    keyed = keyed.join(F.broadcast(_lookup(spark, GENUS_TAU, "_genus", "_by_genus")), "_genus", "left")
    source = (F.when(F.col("_by_species").isNotNull(), F.concat(F.lit("species value for "), "_species"))
              .when(F.col("_by_genus").isNotNull(), F.concat(F.lit("genus default for "), "_genus"))
              .otherwise(F.lit("global default")))
    return (keyed.withColumn("tau", F.coalesce("_by_species", "_by_genus", F.lit(GLOBAL_TAU)))
            .withColumn("tau_source", source)
            .drop("_species", "_genus", "_by_species", "_by_genus"))


def crown_columns(dbh: Column) -> dict[str, Column]:
    """Crown radius, base and top from trunk diameter in centimetres."""
    size = F.greatest(dbh, F.lit(1.0))
    height = F.greatest(F.lit(TREE_HEIGHT_MIN_M), F.pow(size, F.lit(HEIGHT_B)) * HEIGHT_A)
    base = F.greatest(F.lit(CROWN_BASE_MIN_M), height * CROWN_BASE_FRACTION)
    return {
        "crown_radius_m": F.greatest(F.lit(CROWN_RADIUS_MIN_M), F.pow(size, F.lit(CROWN_B)) * CROWN_A),
        "crown_base_m": base,
        "crown_top_m": F.greatest(height, base + 1.0),
    }


def build_crowns(tree_points: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Tree points -> crowns. Missing or tiny diameters take the census median."""
    measured = F.coalesce(F.col("dbh_cm") > 1.0, F.lit(False))
    trees = species_tau(tree_points.withColumn("species", F.coalesce("species", F.lit(""))))
    trees = trees.withColumn("_measured", measured)
    trees = trees.withColumn("dbh_cm", F.when(F.col("_measured"), F.col("dbh_cm").cast("double"))
                             .otherwise(F.lit(MEDIAN_DBH_CM)))
    trees = trees.withColumns(crown_columns(F.col("dbh_cm")))
    note = F.lit(f"; dbh imputed as median {MEDIAN_DBH_CM}cm")
    trees = trees.withColumn("tau_source", F.when(F.col("_measured"), F.col("tau_source"))
                             .otherwise(F.concat("tau_source", note))).drop("_measured")
    return contiguous_ids(trees, "tree_id", order_by) if order_by else trees


def build_prisms(footprints: DataFrame, order_by: list[str]) -> DataFrame:
    """Footprints -> (building_id, height_m, base_m, rings), ids in the given order."""
    return contiguous_ids(footprints, "building_id", order_by).select("building_id", "height_m", "base_m", "rings")


def footprint_bounds(buildings: DataFrame) -> DataFrame:
    x0, y0, x1, y1 = bounds(F.col("rings")[0])
    return buildings.withColumns({"bx0": x0, "by0": y0, "bx1": x1, "by1": y1})
