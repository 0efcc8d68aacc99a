"""Felt temperature per (edge, minute): the cost table behind every walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CROSSING_PENALTY_S, KIND_CROSSING, WALK_SPEED_MS
from ..functions.numeric import as_col
from ..functions.radiation import tmrt, with_sky
from ..functions.shade import f_sun, sky_view
from ..functions.solar import with_sun
from ..functions.utci import with_feels_like, with_weather_curve
from ..session import materialize

#: moments that are broadcast, of about 300 bytes each
FEW_MOMENTS = 10_000


def walk_duration(length_m, kind, speed_ms: float = WALK_SPEED_MS,
                  penalty_s: float = CROSSING_PENALTY_S) -> Column:
    """Seconds to walk an edge; crossings add a wait. Independent of the time of day."""
    wait = F.when(as_col(kind) == KIND_CROSSING, F.lit(penalty_s)).otherwise(F.lit(0.0))
    return as_col(length_m).cast("double") / speed_ms + wait


def instants(keys: DataFrame, weather: DataFrame, lat: float, lon: float) -> DataFrame:
    """(minute, hour_s) pairs with sun and folded weather: one row per distinct pair.

    Everything that does not depend on the sample is computed here once.
    """
    pairs = keys.select("minute", "hour_s").distinct()
    pairs = pairs.withColumns({"epoch_s": F.col("minute") * 60, "lat": F.lit(lat), "lon": F.lit(lon)})
    sky = with_weather_curve(with_sky(weather))
    return with_sun(pairs).drop("epoch_s", "lat", "lon").join(sky, "hour_s")


def shaded_samples(samples: DataFrame, horizon: DataFrame) -> DataFrame:
    """Samples with their horizon arrays and sky view.

    Never by broadcast: samples are listed from edges, and the planner takes all of an edge's for one row.
    """
    return (samples.select("sample_id", "edge_id", F.col("ground_albedo").cast("double").alias("ground_albedo")).hint("merge")
            .join(horizon, "sample_id").withColumn("svf", sky_view(F.col("opaque"))))


def sample_panel(keys: DataFrame, shaded: DataFrame, moments: DataFrame) -> DataFrame:
    """f_sun, tmrt_c and feels_like_c of every sample of every (edge, minute, hour) key.

    Keys and samples are shuffled once, by edge, so that costs of an edge need no further shuffle. Few moments are sent to
    all tasks; of many, keys get theirs first, so that a sample's arrays are not shuffled again with them.
    """
    moments = materialize(moments, "moments")
    asked = keys.select("edge_id", "minute", "hour_s").repartition("edge_id").distinct()
    broadcasts = not keys.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if broadcasts and moments.count() <= FEW_MOMENTS:
        rows = asked.hint("merge").join(shaded, "edge_id").join(F.broadcast(moments), ["minute", "hour_s"])
    else:
        rows = asked.join(moments, ["minute", "hour_s"]).hint("merge").join(shaded, "edge_id")
    rows = rows.withColumn("f_sun", f_sun())
    rows = rows.withColumn("tmrt_c", tmrt(F.col("f_sun"), F.col("svf"), F.col("ground_albedo")))
    return with_feels_like(rows).select(
        "edge_id", "minute", "hour_s", "sample_id", "f_sun", "svf", "tmrt_c", "feels_like_c")


def edge_cost(keys: DataFrame, edges: DataFrame, shaded: DataFrame, moments: DataFrame,
              speed_ms: float = WALK_SPEED_MS) -> DataFrame:
    """One row per distinct (edge_id, minute, hour_s) key.

    The canopy share is classified per sample, before averaging. Heat is felt
    temperature times minutes, so it is negative in frost.
    """
    dappled = F.when((F.col("f_sun") > 0.0) & (F.col("f_sun") < 1.0), 1.0).otherwise(0.0)
    means = sample_panel(keys, shaded, moments).groupBy("edge_id", "minute", "hour_s").agg(
        F.avg("feels_like_c").alias("mean_feels_like_c"), F.avg("f_sun").alias("mean_f_sun"),
        F.avg("svf").alias("mean_svf"), F.avg("tmrt_c").alias("mean_tmrt_c"),
        F.avg(dappled).alias("mean_canopy_fraction"))
    walk = edges.select("edge_id", walk_duration(F.col("length_m"), F.col("kind"), speed_ms).alias("duration_s"))
    return means.join(walk, "edge_id").withColumn(
        "heat_dm", F.col("mean_feels_like_c") * F.col("duration_s") / 60.0)


def scene_health(samples: DataFrame, edges: DataFrame, horizon: DataFrame) -> DataFrame:
    """One row: edge and sample counts and the share of samples with a horizon."""
    present = horizon.select("sample_id", F.lit(1).alias("_warm"))
    warm = samples.select("sample_id").join(present, "sample_id", "left").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(F.coalesce("_warm", F.lit(0)).cast("double")).alias("warm_fraction"))
    return warm.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
