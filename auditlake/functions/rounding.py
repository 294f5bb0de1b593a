"""Rounding and clamping with the rules of the systems whose numbers are matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def half_even(c: Column, digits: int = 0) -> Column:
    """To ``digits`` places, halves to the even neighbour."""
    return F.bround(c, digits)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def first_nonblank(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def when(condition: Column, points: float) -> Column:
    """``points`` where the condition holds, else 0 (null counts as not)."""
    return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))
