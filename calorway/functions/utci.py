"""Universal Thermal Climate Index as Column expressions.

The published regression is a polynomial of total degree six in air temperature,
wind, radiant excess and vapour pressure. For one hour of weather everything but
the radiant excess is constant, so the polynomial folds into seven coefficients
per hour; every sample then costs one degree-six Horner evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col, clip, lerp

# fixed values: regression coefficients as published (Broede et al. 2012), in the
# published term order: vapour power, then radiant power, then wind power, then
# air temperature power, each ascending, total power at most six
UTCI_COEFFICIENTS = (
    0.607562052, -0.0227712343, 8.06470249e-4, -1.54271372e-4, -3.24651735e-6, 7.32602852e-8, 1.35959073e-9,
    -2.25836520, 0.0880326035, 0.00216844454, -1.53347087e-5, -5.72983704e-7, -2.55090145e-9, -0.751269505,
    -0.00408350271, -5.21670675e-5, 1.94544667e-6, 1.14099531e-8, 0.158137256, -6.57263143e-5, 2.22697524e-7,
    -4.16117031e-8, -0.0127762753, 9.66891875e-6, 2.52785852e-9, 4.56306672e-4, -1.74202546e-7, -5.91491269e-6,
    0.398374029, 1.83945314e-4, -1.73754510e-4, -7.60781159e-7, 3.77830287e-8, 5.43079673e-10, -0.0200518269,
    8.92859837e-4, 3.45433048e-6, -3.77925774e-7, -1.69699377e-9, 1.69992415e-4, -4.99204314e-5, 2.47417178e-7,
    1.07596466e-8, 8.49242932e-5, 1.35191328e-6, -6.21531254e-9, -4.99410301e-6, -1.89489258e-8, 8.15300114e-8,
    7.55043090e-4, -5.65095215e-5, -4.52166564e-7, 2.46688878e-8, 2.42674348e-10, 1.54547250e-4, 5.24110970e-6,
    -8.75874982e-8, -1.50743064e-9, -1.56236307e-5, -1.33895614e-7, 2.49709824e-9, 6.51711721e-7, 1.94960053e-9,
    -1.00361113e-8,
    -1.21206673e-5, -2.18203660e-7, 7.51269482e-9, 9.79063848e-11, 1.25006734e-6, -1.81584736e-9, -3.52197671e-10,
    -3.36514630e-8, 1.35908359e-10, 4.17032620e-10,
    -1.30369025e-9, 4.13908461e-10, 9.22652254e-12, -5.08220384e-9, -2.24730961e-11, 1.17139133e-10,
    6.62154879e-10, 4.03863260e-13, 1.95087203e-12,
    -4.73602469e-12,
    5.12733497, -0.312788561, -0.0196701861, 9.99690870e-4, 9.51738512e-6, -4.66426341e-7, 0.548050612,
    -0.00330552823, -0.00164119440, -5.16670694e-6, 9.52692432e-7, -0.0429223622, 0.00500845667, 1.00601257e-6,
    -1.81748644e-6, -1.25813502e-3, -1.79330391e-4, 2.34994441e-6, 1.29735808e-4, 1.29064870e-6, -2.28558686e-6,
    -0.0369476348, 0.00162325322, -3.14279680e-5, 2.59835559e-6, -4.77136523e-8, 8.64203390e-3, -6.87405181e-4,
    -9.13863872e-6, 5.15916806e-7, -3.59217476e-5, 3.28696511e-5, -7.10542454e-7, -1.24382300e-5, -7.38584400e-9,
    2.20609296e-7,
    -7.32469180e-4, -1.87381964e-5, 4.80925239e-6, -8.75492040e-8, 2.77862930e-5, -5.06004592e-6, 1.14325367e-7,
    2.53016723e-6, -1.72857035e-8, -3.95079398e-8,
    -3.59413173e-7, 7.04388046e-7, -1.89309167e-8, -4.79768731e-7, 7.96079978e-9, 1.62897058e-9,
    3.94367674e-8, -1.18566247e-9, 3.34678041e-10,
    -1.15606447e-10,
    -2.80626406, 0.548712484, -0.00399428410, -9.54009191e-4, 1.93090978e-5, -0.308806365, 0.0116952364,
    4.95271903e-4, -1.90710882e-5, 0.00210787756, -6.98445738e-4, 2.30109073e-5, 4.17856590e-4, -1.27043871e-5,
    -3.04620472e-6,
    0.0514507424, -0.00432510997, 8.99281156e-5, -7.14663943e-7, -2.66016305e-4, 2.63789586e-4, -7.01199003e-6,
    -1.06823306e-4, 3.61341136e-6, 2.29748967e-7,
    3.04788893e-4, -6.42070836e-5, 1.16257971e-6, 7.68023384e-6, -5.47446896e-7, -3.59937910e-8,
    -4.36497725e-6, 1.68737969e-7, 2.67489271e-8,
    3.23926897e-9,
    -0.0353874123, -0.221201190, 0.0155126038, -2.63917279e-4, 0.0453433455, -0.00432943862, 1.45389826e-4,
    2.17508610e-4, -6.66724702e-5, 3.33217140e-5,
    -0.00226921615, 3.80261982e-4, -5.45314314e-9, -7.96355448e-4, 2.53458034e-5, -6.31223658e-6,
    3.02122035e-4, -4.77403547e-6, 1.73825715e-6,
    -4.09087898e-7,
    0.614155345, -0.0616755931, 0.00133374846, 0.00355375387, -5.13027851e-4, 1.02449757e-4,
    -0.00148526421, -4.11469183e-5, -6.80434415e-6,
    -9.77675906e-6,
    0.0882773108, -0.00301859306, 0.00104452989,
    2.47090539e-4,
    0.00148348065,
)

# fixed values: validity ranges and saturation-pressure fit
AIR_RANGE_C = (-50.0, 50.0)
EXCESS_RANGE_C = (-30.0, 70.0)
WIND_RANGE_MS = (0.5, 17.0)
SATURATION_FIT = (
    -2836.5744, -6028.076559, 19.54263612, -0.02737830188,
    0.000016261698, 7.0229056e-10, -1.8680009e-13,
)
SATURATION_LOG = 2.7150305

# fixed values: the lookup grid of radiant temperatures
CURVE_LOW_C, CURVE_STEP_C, CURVE_POINTS = -30.0, 0.5, 241


def _horner(coefficients, x: Column) -> Column:
    total = as_col(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + as_col(c)
    return total


def saturation_vapour_kpa(air_c) -> Column:
    """Saturation pressure over water, kPa (the index's own fit)."""
    tk = as_col(air_c) + 273.15
    # powers -2..4: factor tk^-2 out of the polynomial
    fit = _horner([F.lit(c) for c in SATURATION_FIT], tk) / (tk * tk)
    return F.exp(fit + F.log(tk) * SATURATION_LOG) * 0.001


def excess_coefficients(ta: Column, wind: Column, pa: Column) -> list[Column]:
    """Seven columns c0..c6 with UTCI = sum of c_k * excess^k, from clamped inputs."""
    terms = iter(UTCI_COEFFICIENTS)
    by_excess: list[list[Column]] = [[] for _ in range(7)]
    for vapour in range(7):
        for excess in range(7 - vapour):
            by_wind = []
            for w in range(7 - vapour - excess):
                by_air = [F.lit(next(terms)) for _ in range(7 - vapour - excess - w)]
                by_wind.append(_horner(by_air, ta))
            by_excess[excess].append(_horner(by_wind, wind))
    folded = [_horner(by_vapour, pa) for by_vapour in by_excess]
    folded[0] = folded[0] + ta
    return folded


def with_weather_curve(weather: DataFrame) -> DataFrame:
    """Adds curve_air_c and utci_c0..utci_c6 to a table of weather rows."""
    out = weather.withColumns({"curve_air_c": clip(F.col("air_temp_c"), *AIR_RANGE_C),
                               "_wind": clip(F.col("wind_speed_10m_ms"), *WIND_RANGE_MS)})
    out = out.withColumn("_pa", saturation_vapour_kpa(F.col("curve_air_c")) * (clip(F.col("relative_humidity_pct"), 0.0, 100.0) / 100.0))
    folded = excess_coefficients(F.col("curve_air_c"), F.col("_wind"), F.col("_pa"))
    return out.withColumns({f"utci_c{k}": column for k, column in enumerate(folded)}).drop("_wind", "_pa")


def utci_exact(tmrt_c) -> Column:
    """The polynomial itself, from the folded columns of with_weather_curve."""
    excess = clip(as_col(tmrt_c) - F.col("curve_air_c"), *EXCESS_RANGE_C)
    return _horner([F.col(f"utci_c{k}") for k in range(7)], excess)


def with_feels_like(df: DataFrame) -> DataFrame:
    """Adds feels_like_c from tmrt_c: linear interpolation on the half-degree grid, without storing the grid.

    Equals reading a 241-point table built for the row's hour, because both grid
    neighbours are evaluated from the folded coefficients.
    """
    position = clip((F.col("tmrt_c") - CURVE_LOW_C) / CURVE_STEP_C, 0.0, CURVE_POINTS - 1.0001)
    out = df.withColumn("_pos", position).withColumn("_low", F.floor("_pos").cast("double"))
    for name, up in (("_x0", 0.0), ("_x1", 1.0)):
        at = (F.col("_low") + up) * CURVE_STEP_C + CURVE_LOW_C
        out = out.withColumn(name, clip(at - F.col("curve_air_c"), *EXCESS_RANGE_C))
    coefficients = [F.col(f"utci_c{k}") for k in range(7)]
    felt = lerp(_horner(coefficients, F.col("_x0")), _horner(coefficients, F.col("_x1")), F.col("_pos") - F.col("_low"))
    return out.withColumn("feels_like_c", felt).drop("_pos", "_low", "_x0", "_x1")


def utci_curve(weather: DataFrame) -> DataFrame:
    """241 rows (tmrt_c, utci_c) per weather row."""
    step = F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))).alias("step")
    grid = with_weather_curve(weather).select("*", step)
    grid = grid.withColumn("tmrt_c", F.col("step") * CURVE_STEP_C + CURVE_LOW_C)
    return grid.withColumn("utci_c", utci_exact(F.col("tmrt_c")))


def pedestrian_wind(wind_10m_ms, height_m: float = 1.1) -> Column:
    """Neutral log profile to walking height, kept in the index's wind range."""
    ratio = F.log(F.greatest(F.lit(height_m), F.lit(0.5)) + 1.0) / F.log(F.lit(11.0))
    return clip(as_col(wind_10m_ms) * ratio, *WIND_RANGE_MS)
