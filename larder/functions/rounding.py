"""The two rounding families of the rule sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """To the nearest whole number, ties to the even one, as int."""
    return F.bround(x.cast("double")).cast("int")


def half_up(x: Column) -> Column:
    """floor(x + 0.5), as double: ties go up, for negative numbers too."""
    return F.floor(x.cast("double") + F.lit(0.5)).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
