"""Hourly weather joined to instants, and time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import as_col

# fixed values: weather grid, and the labelled stand-in row for a missing feed
GRID_DEG = 0.05
DAY_S = 86_400
FALLBACK = {
    "air_temp_c": 32.0, "relative_humidity_pct": 45.0, "wind_speed_10m_ms": 3.0,
    "cloud_cover_pct": 10.0, "direct_normal_wm2": 800.0, "diffuse_wm2": 150.0,
    "global_horizontal_wm2": 700.0, "uv_index": 8.0, "source": "fallback (network unavailable)",
}


def weather_cell(lat, lon) -> tuple[Column, Column]:
    """Keys of the cell whose series serves a place; halves round to even."""
    return (F.rint(as_col(lat) / GRID_DEG).cast("long"), F.rint(as_col(lon) / GRID_DEG).cast("long"))


def forecast_hour(at_s) -> Column:
    """Nearest full hour, exact half hours going to the earlier one."""
    return (F.ceil((as_col(at_s) - 1800) / 3600.0) * 3600).cast("long")


def nearest_hour(requests: DataFrame, weather: DataFrame, by: list[str]) -> DataFrame:
    """Adds hour_s, the weather hour nearest to at_s; ties go to the earlier hour.

    Works on distinct instants of each series, day by day, so the windows see the
    minutes and hours of one day; a row per day carries the nearest hours over days
    without any. Without weather hour_s stays null.
    """
    day = F.floor(F.col("at_s") / DAY_S).alias("_day")
    instants = requests.select(*by, "at_s").distinct().withColumn("_hour", F.lit(None).cast("long"))
    stamps = weather.select(*by, F.col("hour_s").alias("at_s"), F.col("hour_s").alias("_hour"))
    days = instants.select(*by, day, "_hour").unionByName(stamps.select(*by, day, "_hour")).groupBy(*by, "_day").agg(
        F.min("_hour").alias("_low"), F.max("_hour").alias("_high"))
    series = W.partitionBy(*by).orderBy("_day")
    days = days.select(*by, "_day", F.last("_high", ignorenulls=True).over(series.rowsBetween(W.unboundedPreceding, -1)).alias("_past"),
                       F.first("_low", ignorenulls=True).over(series.rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    order = W.partitionBy(*by, "_day").orderBy("at_s", F.col("_hour").asc_nulls_last())
    before = F.last("_hour", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_hour", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    near = instants.unionByName(stamps).select("*", day).select(
        *by, "_day", "at_s", "_hour", before.alias("_before"), after.alias("_after")).filter("_hour IS NULL")
    near = near.join(days, [*by, "_day"]).withColumns({"_before": F.coalesce("_before", "_past"), "_after": F.coalesce("_after", "_next")})
    earlier = F.col("_after").isNull() | (
        F.col("at_s") - F.col("_before") <= F.col("_after") - F.col("at_s"))
    chosen = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    return requests.join(near.select(*by, "at_s", chosen.alias("hour_s")), [*by, "at_s"])


def weather_at(requests: DataFrame, weather: DataFrame, by: list[str]) -> DataFrame:
    """Requests with the weather columns of their nearest hour, or the labelled fallback."""
    placed = nearest_hour(requests, weather, by).join(weather, [*by, "hour_s"], "left")
    return placed.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in FALLBACK.items()})


def weather_series(starts: DataFrame, weather: DataFrame, hours: int, by: list[str]) -> DataFrame:
    """One row per start and hour offset: weather at at_s + h hours."""
    step = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour_no")
    grid = starts.select("*", step).withColumn("at_s", F.col("at_s") + F.col("hour_no") * 3600)
    return weather_at(grid, weather, by)


def departures(starts: DataFrame, hours: int, name: str = "depart_s") -> DataFrame:
    """Every quarter hour over the window, starting at the row's own time."""
    step = F.explode(F.sequence(F.lit(0), F.lit(hours * 4 - 1))).alias("depart_no")
    return starts.select("*", step).withColumn(name, F.col(name) + F.col("depart_no") * 900)


def time_grid(rows: DataFrame, start: str, window_min: Column, step_min: int) -> DataFrame:
    """max(2, floor(window / step) + 1) instants, step minutes apart."""
    steps = F.greatest(F.lit(2), F.floor(window_min / float(step_min)).cast("int") + 1)
    return (rows.select("*", F.explode(F.sequence(F.lit(0), steps - 1)).alias("step_no"))
            .withColumn("at_s", F.col(start) + F.col("step_no") * (step_min * 60)))
