"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip(value, low, high) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def floor_mod(value, modulus: float) -> Column:
    """Result takes the sign of the modulus."""
    return F.pmod(as_col(value), F.lit(modulus))


def round_half_up(value) -> Column:
    """floor(x + 0.5), the display rounding of the client formulas."""
    return F.floor(as_col(value) + 0.5)


def lerp(a, b, weight) -> Column:
    return as_col(a) * (F.lit(1.0) - weight) + as_col(b) * weight
