"""Horizons, sky view and beam shade of every sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shade import sky_view
from ..operators import horizon as H
from . import derived_city as city
from .oracle import compose
from .registry import query, stage


def horizon_rows(spark, sf):
    return H.horizons(city.samples(spark, sf), city.buildings(spark, sf), city.trees(spark, sf))


def horizon_table(spark, sf):
    return stage(spark, sf, "horizon", lambda: horizon_rows(spark, sf))


@query("horizon_walls", compose("""
    SELECT building_id::BIGINT AS building_id, height_m, ax, ay, bx, yb AS "by" FROM walls""", "walls"))
def horizon_walls(spark, sf):
    return H.walls(city.buildings(spark, sf))


@query("horizon_inside_footprint", compose("SELECT sample_id::BIGINT AS sample_id FROM inside", "inside"))
def horizon_inside_footprint(spark, sf):
    return H.samples_inside(city.samples(spark, sf), city.buildings(spark, sf))


@query("building_horizon", compose("""
    SELECT sample_id::BIGINT AS sample_id, array_to_string(opaque, ',') AS opaque FROM opaque""", "opaque"))
def building_horizon(spark, sf):
    out = H.building_horizon(city.samples(spark, sf), city.buildings(spark, sf))
    return out.select("sample_id", F.array_join(F.col("opaque").cast("array<string>"), ",").alias("opaque"))


@query("canopy_horizon", compose("""
    SELECT sample_id::BIGINT AS sample_id, array_to_string(canopy, ',') AS canopy FROM canopy""", "canopy"))
def canopy_horizon(spark, sf):
    out = H.canopy_horizon(city.samples(spark, sf), city.trees(spark, sf))
    return out.select("sample_id", F.array_join(F.col("canopy").cast("array<string>"), ",").alias("canopy"))


@query("tau_profile", compose("""
    SELECT sample_id::BIGINT AS sample_id, array_to_string(tau_q, ',') AS tau_q FROM canopy""", "canopy"))
def tau_profile(spark, sf):
    out = H.canopy_horizon(city.samples(spark, sf), city.trees(spark, sf))
    return out.select("sample_id", F.array_join(F.col("tau_q").cast("array<string>"), ",").alias("tau_q"))


@query("sky_view_factor", compose("""
    SELECT sample_id::BIGINT AS sample_id, round(1 - avg(pow(sin(radians(opaque)), 2)), 6) AS svf
    FROM opaque_bins GROUP BY 1""", "opaque_bins"))
def sky_view_factor(spark, sf):
    return horizon_table(spark, sf).select("sample_id", F.round(sky_view(F.col("opaque")), 6).alias("svf"))
