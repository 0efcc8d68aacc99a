"""Raster work on pixel tables (row, col, class): integer-key joins, no raster library.

Row 0 is the northernmost; a raster is (x0, y1, resolution) with y1 its top edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_ALBEDO, DEFAULT_ALBEDO, DEFAULT_LANDCOVER_CLASS

CANOPY_CLASS = 1


def pixel_keys(x: Column, y: Column, x0: float, y1: float, resolution: float) -> tuple[Column, Column]:
    return (F.floor((F.lit(y1) - y) / resolution).cast("long"), F.floor((x - F.lit(x0)) / resolution).cast("long"))


def albedo_of_class(cls: Column) -> Column:
    out = None
    for c, a in CLASS_ALBEDO.items():
        out = F.when(cls == c, F.lit(a)) if out is None else out.when(cls == c, F.lit(a))
    return out.otherwise(F.lit(DEFAULT_ALBEDO))


def landcover_lookup(points: DataFrame, pixels: DataFrame, x0: float, y1: float, resolution: float) -> DataFrame:
    """Adds landcover_class and ground_albedo at each point; concrete where the raster has no pixel."""
    row, col = pixel_keys(F.col("x_m"), F.col("y_m"), x0, y1, resolution)
    joined = points.drop("landcover_class", "ground_albedo").withColumns({"row": row, "col": col}).join(pixels, ["row", "col"], "left")
    cls = F.coalesce("class", F.lit(DEFAULT_LANDCOVER_CLASS))
    return joined.withColumns({"landcover_class": cls, "ground_albedo": albedo_of_class(cls)}).drop("row", "col", "class")


def canopy_mask(scope: DataFrame, pixels: DataFrame, x0: float, y1: float, resolution: float, out_resolution: float = 1.0) -> DataFrame:
    """(row, col) of canopy pixels over scopes (mx0, my0, mx1, my1), nearest source pixel to each centre.

    Every canopy pixel names the target pixels whose centres it holds, so the work follows
    the canopy and is spread as the pixels are; no grid is made from a scope.
    """
    width = F.greatest(F.lit(1), F.floor((F.col("mx1") - F.col("mx0")) / out_resolution).cast("long"))
    height = F.greatest(F.lit(1), F.floor((F.col("my1") - F.col("my0")) / out_resolution).cast("long"))
    west, north = F.lit(x0) + F.col("col") * resolution, F.lit(y1) - F.col("row") * resolution
    # a scope is one row per build
    near = pixels.filter(F.col("class") == CANOPY_CLASS).select("row", "col").join(F.broadcast(scope), (
        (west <= F.col("mx1") + out_resolution) & (west + resolution >= F.col("mx0") - out_resolution)
        & (north >= F.col("my0") - out_resolution) & (north - resolution <= F.col("my1") + out_resolution)))

    def span(low: Column, high: Column, size: Column) -> Column:
        # one more on either side than the pixel is wide; centres are tested below
        first, last = F.greatest(F.floor(low) - 1, F.lit(0)), F.least(F.ceil(high) + 1, size - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))

    rows = near.withColumn("out_col", F.explode(span((west - F.col("mx0")) / out_resolution, (west + resolution - F.col("mx0")) / out_resolution, width)))
    rows = rows.withColumn("out_row", F.explode(span((F.col("my1") - north) / out_resolution, (F.col("my1") - north + resolution) / out_resolution, height)))
    cx = F.col("mx0") + (F.col("out_col") + 0.5) * out_resolution
    cy = F.col("my1") - (F.col("out_row") + 0.5) * out_resolution
    row, col = pixel_keys(cx, cy, x0, y1, resolution)
    return rows.filter((row == F.col("row")) & (col == F.col("col"))).select(F.col("out_row").alias("row"), F.col("out_col").alias("col"))


def crown_pixels(trees: DataFrame, x0: float, y1: float, resolution: float, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Distinct (row, col) whose centre lies in some crown, clipped to the raster when its size is given."""
    c, r = (F.col("x_m") - x0) / resolution, (F.lit(y1) - F.col("y_m")) / resolution
    radius = F.col("crown_radius_m") / resolution
    discs = trees.select(c.alias("_c"), r.alias("_r"), radius.cast("double").alias("_q")).filter("_q > 0")
    span = {n: F.explode(F.sequence(F.floor(F.col(v) - F.col("_q") - 1).cast("long"), F.ceil(F.col(v) + F.col("_q") + 1).cast("long")))
            for n, v in (("row", "_r"), ("col", "_c"))}
    near = discs.withColumn("row", span["row"]).withColumn("col", span["col"])
    dx, dy = F.col("col") + 0.5 - F.col("_c"), F.col("row") + 0.5 - F.col("_r")
    inside = near.filter(dx * dx + dy * dy <= F.col("_q") * F.col("_q"))
    if rows is not None:
        inside = inside.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return inside.select("row", "col").distinct()


def canopy_accuracy(modelled: DataFrame, mask: DataFrame | None, resolution: float) -> DataFrame:
    """One row: recall, precision and areas of modelled crowns against the mask."""
    if mask is None:
        spark = modelled.sparkSession
        return spark.createDataFrame([("skipped", None, None, None, None)],
                                     "status string, recall double, precision double, modelled_area_m2 double, raster_area_m2 double")
    both = modelled.withColumn("m", F.lit(1)).join(mask.withColumn("k", F.lit(1)), ["row", "col"], "full")
    n = both.agg(F.count("m").alias("m"), F.count("k").alias("k"), F.count_if(F.col("m").isNotNull() & F.col("k").isNotNull()).alias("b"))
    area = resolution * resolution
    return n.select(F.lit("ok").alias("status"), (F.col("b") / F.greatest(F.lit(1), "k")).alias("recall"),
                    (F.col("b") / F.greatest(F.lit(1), "m")).alias("precision"), (F.col("m") * area).alias("modelled_area_m2"),
                    (F.col("k") * area).alias("raster_area_m2"))
