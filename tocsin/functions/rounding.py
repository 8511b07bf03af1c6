"""Rounding that agrees with Python's ``round`` on binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_whole(x: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(x)


def round_cents(x: Column) -> Column:
    """Two decimals, judged on the exact binary value, true ties to even.

    ``x * 100`` may land on a half only because the product was rounded, so its
    rounding error is worked out exactly (the factor 100 needs no splitting) and
    decides those cases.
    """
    x = x.cast("double")
    product = x * 100.0
    scaled = x * 134217729.0
    high = scaled - (scaled - x)
    low = x - high
    error = (high * 100.0 - product) + low * 100.0
    on_half = F.abs(product - F.rint(product)) == 0.5
    whole = (
        F.when(on_half & (error > 0), product + 0.5)
        .when(on_half & (error < 0), product - 0.5)
        .otherwise(F.rint(product))
    )
    return whole / 100.0
