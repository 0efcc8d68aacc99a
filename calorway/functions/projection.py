"""EPSG:4326 <-> EPSG:32118 (Lambert conformal conic, GRS80) as Column maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# fixed values: GRS80 ellipsoid and the New York Long Island zone
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
LATITUDE_ORIGIN_DEG = 40.0 + 10.0 / 60.0
LONGITUDE_ORIGIN_DEG = -74.0
PARALLEL_SOUTH_DEG = 40.0 + 40.0 / 60.0
PARALLEL_NORTH_DEG = 41.0 + 2.0 / 60.0
FALSE_EASTING_M = 300000.0

_F = 1.0 / INVERSE_FLATTENING
ECCENTRICITY = math.sqrt(_F * (2.0 - _F))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1.0 - (ECCENTRICITY * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    es = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4.0 - phi / 2.0) / ((1.0 - es) / (1.0 + es)) ** (ECCENTRICITY / 2.0)


_PHI1, _PHI2 = math.radians(PARALLEL_SOUTH_DEG), math.radians(PARALLEL_NORTH_DEG)
CONE = (math.log(_m(_PHI1)) - math.log(_m(_PHI2))) / (math.log(_t(_PHI1)) - math.log(_t(_PHI2)))
SCALE = _m(_PHI1) / (CONE * _t(_PHI1) ** CONE)
RHO_ORIGIN_M = SEMI_MAJOR_M * SCALE * _t(math.radians(LATITUDE_ORIGIN_DEG)) ** CONE
_INVERSE_ROUNDS = 5


def to_metres(lon, lat) -> tuple[Column, Column]:
    """(x_m, y_m) of WGS84 degrees."""
    phi = F.radians(as_col(lat))
    es = F.sin(phi) * ECCENTRICITY
    t = F.tan(F.lit(math.pi / 4.0) - phi / 2.0) / F.pow(
        (F.lit(1.0) - es) / (es + 1.0), F.lit(ECCENTRICITY / 2.0))
    rho = F.pow(t, F.lit(CONE)) * (SEMI_MAJOR_M * SCALE)
    theta = F.radians(as_col(lon) - LONGITUDE_ORIGIN_DEG) * CONE
    return rho * F.sin(theta) + FALSE_EASTING_M, F.lit(RHO_ORIGIN_M) - rho * F.cos(theta)


def to_degrees(x_m, y_m) -> tuple[Column, Column]:
    """(lon, lat) of projected metres, by a fixed number of fixed-point steps."""
    dx, dy = as_col(x_m) - FALSE_EASTING_M, F.lit(RHO_ORIGIN_M) - as_col(y_m)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / (SEMI_MAJOR_M * SCALE), F.lit(1.0 / CONE))
    start = F.lit(math.pi / 2.0) - F.atan(t) * 2.0
    steps = F.sequence(F.lit(1), F.lit(_INVERSE_ROUNDS))

    def refine(phi, _):
        es = F.sin(phi) * ECCENTRICITY
        return F.lit(math.pi / 2.0) - F.atan(
            t * F.pow((F.lit(1.0) - es) / (es + 1.0), F.lit(ECCENTRICITY / 2.0))) * 2.0

    lat = F.degrees(F.aggregate(steps, start, refine))
    lon = F.degrees(F.atan2(dx, dy) / CONE) + LONGITUDE_ORIGIN_DEG
    return lon, lat


def box_to_metres(west, south, east, north) -> tuple[Column, Column, Column, Column]:
    """Bounds (x0, y0, x1, y1) of the four projected corners."""
    corners = [to_metres(lon, lat) for lon in (west, east) for lat in (south, north)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)
