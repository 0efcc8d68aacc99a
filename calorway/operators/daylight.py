"""Day-long sun tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solar import with_sun

# fixed values: elevation of the upper limb at rise and set with mean refraction
RISE_SET_DEG = -0.833
TRACK_POINTS = 96


def _through_day(days: DataFrame, step_s: int, steps: int) -> DataFrame:
    grid = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i"))
    return with_sun(grid.withColumn("epoch_s", F.col("day_s") + F.col("_i") * step_s).drop("_i"))


def elevation_track(days: DataFrame) -> DataFrame:
    """97 points from one local midnight (day_s) to the next; days need lat and lon."""
    return _through_day(days, 86400 // TRACK_POINTS, TRACK_POINTS)


def daylight_window(days: DataFrame) -> DataFrame:
    """First and last minute of the day with the sun up; no row on a polar night."""
    up = _through_day(days, 60, 1439).filter(F.col("elevation_deg") > RISE_SET_DEG)
    return up.groupBy("day_s", "lat", "lon").agg(F.min("epoch_s").alias("sunrise_s"), F.max("epoch_s").alias("sunset_s"))
