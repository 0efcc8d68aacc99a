"""Shade lookups on the arrays of the horizon table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AZIMUTH_BINS
from .numeric import lerp


def sky_view(opaque: Column) -> Column:
    """1 - mean sin^2 of the building horizon; canopy does not count."""
    def square(b: Column) -> Column:
        return F.pow(F.sin(F.radians(b.cast("double"))), F.lit(2.0))
    # the terms of a whole horizon are written out, which compiles; a fold runs value by value
    whole = F.lit(0.0)
    for b in range(AZIMUTH_BINS):
        whole = whole + square(F.get(opaque, F.lit(b)))
    other = F.aggregate(opaque, F.lit(0.0), lambda acc, b: acc + square(b))
    total = F.when(F.size(opaque) == AZIMUTH_BINS, whole).otherwise(other)
    return F.lit(1.0) - total / float(AZIMUTH_BINS)


def _between_bins(values: Column) -> Column:
    return lerp(F.element_at(values, F.col("az_low")).cast("double"),
                F.element_at(values, F.col("az_high")).cast("double"), F.col("az_weight"))


def f_sun() -> Column:
    """Share of the direct beam for rows with horizon arrays and the columns of with_sun.

    0 behind a building or at night, tau under canopy, else 1.
    """
    elevation = F.col("elevation_deg")
    transmitted = F.when(_between_bins(F.col("canopy")) >= elevation, _between_bins(F.col("tau_q")) / 255.0).otherwise(F.lit(1.0))
    return (F.when(elevation <= 0.0, F.lit(0.0))
            .when(_between_bins(F.col("opaque")) >= elevation, F.lit(0.0)).otherwise(transmitted))
