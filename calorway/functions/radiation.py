"""Mean radiant temperature of a standing person, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col, clip

# fixed values: radiation model
STEFAN_BOLTZMANN = 5.670374419e-8
KELVIN = 273.15
ABSORPTIVITY_SHORTWAVE = 0.70
EMISSIVITY_LONGWAVE = 0.97
FACE_VERTICAL = 0.06
FACE_SIDE = 0.22
BEAM_PROJECTION = 0.28
SUNLIT_BUMP_C = 18.0
SHADED_BUMP_C = 2.0
SURFACE_EMISSIVITY = 0.95
WALL_ALBEDO = 0.20
FULL_SUN_WM2 = 900.0


def vapour_pressure_hpa(air_c, rh_pct) -> Column:
    t = as_col(air_c)
    return F.exp(t * 17.62 / (t + 243.12)) * 6.112 * as_col(rh_pct) / 100.0


def sky_emissivity(air_c, rh_pct, cloud_pct) -> Column:
    xi = vapour_pressure_hpa(air_c, rh_pct) * 46.5 / (as_col(air_c) + KELVIN)
    clear = F.lit(1.0) - (xi + 1.0) * F.exp(-F.sqrt(xi * 3.0 + 1.2))
    cloud = clip(as_col(cloud_pct) / 100.0, 0.0, 1.0)
    return clip(clear + (F.lit(1.0) - clear) * cloud, 0.0, 1.0)


def surface_temp_c(air_c, f_sun, global_wm2) -> Column:
    drive = clip(as_col(global_wm2) / FULL_SUN_WM2, 0.0, 1.0)
    return as_col(air_c) + (as_col(f_sun) * (SUNLIT_BUMP_C - SHADED_BUMP_C) + SHADED_BUMP_C) * drive


def _fourth(x: Column) -> Column:
    square = x * x
    return square * square


def with_sky(weather: DataFrame) -> DataFrame:
    """Adds sky_longwave_wm2: the part of the balance that only weather decides."""
    eps = sky_emissivity(F.col("air_temp_c"), F.col("relative_humidity_pct"), F.col("cloud_cover_pct"))
    return weather.withColumn(
        "sky_longwave_wm2", eps * _fourth(F.col("air_temp_c") + KELVIN) * STEFAN_BOLTZMANN)


def tmrt(f_sun, svf, ground_albedo, wall_albedo: float = WALL_ALBEDO, prefix: str = "") -> Column:
    """Radiant temperature from shade columns and the columns of with_sky."""
    f_sun, svf = as_col(f_sun), as_col(svf)
    beam, diffuse, total = (F.col(prefix + c) for c in (
        "direct_normal_wm2", "diffuse_wm2", "global_horizontal_wm2"))
    walled = F.lit(1.0) - svf

    # each face of the body sees sky over svf and walls over the rest
    upward_short = svf * diffuse + walled * wall_albedo * total
    short = (
        f_sun * beam * BEAM_PROJECTION
        + upward_short * FACE_VERTICAL
        + as_col(ground_albedo) * total * FACE_VERTICAL
        + upward_short * (0.5 * 4.0 * FACE_SIDE)
    ) * ABSORPTIVITY_SHORTWAVE

    surface = surface_temp_c(F.col(prefix + "air_temp_c"), f_sun, total) + KELVIN
    ground_long = _fourth(surface) * (SURFACE_EMISSIVITY * STEFAN_BOLTZMANN)
    upward_long = svf * F.col(prefix + "sky_longwave_wm2") + walled * ground_long
    long = (
        upward_long * FACE_VERTICAL
        + ground_long * FACE_VERTICAL
        + (upward_long + ground_long) * (0.5 * 4.0 * FACE_SIDE)
    ) * EMISSIVITY_LONGWAVE

    return F.pow((short + long) / (EMISSIVITY_LONGWAVE * STEFAN_BOLTZMANN), F.lit(0.25)) - KELVIN
