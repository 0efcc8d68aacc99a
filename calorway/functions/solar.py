"""Sun position (NOAA equations) as Column expressions over epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AZIMUTH_BINS, BIN_WIDTH_DEG
from .numeric import as_col, clip, floor_mod


def with_sun(df: DataFrame, epoch_s: str = "epoch_s", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds azimuth_deg (compass), elevation_deg (negative at night) and the azimuth's place between bins.

    One step per intermediate, so each is computed once. Call it on the distinct
    (instant, site) rows and join: the sun never needs evaluating per sample.
    az_low and az_high are 1-based array positions, az_weight the share of the upper one.
    """
    c = F.col
    ts = c(epoch_s).cast("double")
    jc, ml, ma, ec, y, ha, dec, phi = (c(n) for n in ("_jc", "_ml", "_ma", "_ec", "_y", "_ha", "_dec", "_phi"))
    out = df.withColumn("_jc", (ts / 86400.0 + 2440587.5 - 2451545.0) / 36525.0)
    out = out.withColumns({
        "_ml": F.radians(floor_mod(jc * (jc * 0.0003032 + 36000.76983) + 280.46646, 360.0)),
        "_ma": F.radians(jc * (jc * -0.0001537 + 35999.05029) + 357.52911),
        "_ec": jc * (jc * -0.0000001267 - 0.000042037) + 0.016708634,
        "_node": F.radians(jc * -1934.136 + 125.04), "_phi": F.radians(lat)})
    centre = F.radians(
        F.sin(ma) * (jc * (jc * -0.000014 - 0.004817) + 1.914602)
        + F.sin(ma * 2.0) * (jc * -0.000101 + 0.019993) + F.sin(ma * 3.0) * 0.000289)
    arcsec = jc * (jc * (jc * 0.001813 - 0.00059) - 46.815) + 21.448
    out = out.withColumns({
        "_app": ml + centre - F.radians(F.sin("_node") * 0.00478 + 0.00569),
        "_tilt": F.radians(arcsec / 3600.0 + 26.0 / 60.0 + 23.0) + F.radians(F.cos("_node") * 0.00256)})
    out = out.withColumns({"_dec": F.asin(F.sin("_tilt") * F.sin("_app")), "_y": F.pow(F.tan(c("_tilt") / 2.0), F.lit(2.0))})
    eq_time = F.degrees(
        y * F.sin(ml * 2.0) - ec * F.sin(ma) * 2.0 + ec * y * F.sin(ma) * F.cos(ml * 2.0) * 4.0
        - y * y * F.sin(ml * 4.0) * 0.5 - ec * ec * F.sin(ma * 2.0) * 1.25) * 4.0
    solar_min = floor_mod(floor_mod(ts, 86400.0) / 60.0 + eq_time + c(lon) * 4.0, 1440.0)
    out = out.withColumn("_ha", F.radians(solar_min / 4.0 - 180.0))
    out = out.withColumn("_cz", clip(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(ha), -1.0, 1.0))
    out = out.withColumn("_zen", F.acos("_cz"))
    out = out.withColumn("_den", F.cos(phi) * F.sin("_zen"))
    ratio = F.when(F.abs("_den") < 1e-9, F.lit(0.0)).otherwise((F.sin(phi) * F.cos("_zen") - F.sin(dec)) / c("_den"))
    out = out.withColumn("_half", F.degrees(F.acos(clip(ratio, -1.0, 1.0))))
    out = out.withColumns({
        "azimuth_deg": F.when(ha > 0.0, floor_mod(c("_half") + 180.0, 360.0)).otherwise(floor_mod(F.lit(540.0) - c("_half"), 360.0)),
        "elevation_deg": F.lit(90.0) - F.degrees("_zen")})
    position = c("azimuth_deg") / BIN_WIDTH_DEG
    low = (F.floor(position) % AZIMUTH_BINS).cast("int")
    return out.withColumns({"az_low": low + 1, "az_high": (low + 1) % AZIMUTH_BINS + 1, "az_weight": position - F.floor(position)}).drop(
        "_jc", "_ml", "_ma", "_ec", "_node", "_phi", "_app", "_tilt", "_dec", "_y", "_ha", "_cz", "_zen", "_den", "_half")


def minute_of(epoch_s) -> Column:
    """Whole minutes since the epoch: the precision of all sun and cost tables."""
    return F.floor(as_col(epoch_s) / 60.0).cast("long")
