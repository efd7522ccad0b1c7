"""Saturating number normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the constant for which 2 maps to 0.9.
HALF_SATURATION = 2 * (1 - 0.9) / 0.9


def normalize_number(col: Column, half_saturation: float | None = None) -> Column:
    """``x / (x + a)``: 0 for anything not above 0, rising towards 1; null stays null."""
    a = HALF_SATURATION if half_saturation is None else float(half_saturation)
    x = col.cast("double")
    return F.when(x <= 0, F.lit(0.0)).otherwise(x / (x + F.lit(a)))


def normalize_number_list(col: Column) -> Column:
    """:func:`normalize_number` for every entry of an array that is 0 or more.

    Spark sorts NaN above every number, so NaN is taken out by name.
    """
    kept = F.filter(col, lambda x: (x >= 0) & ~F.isnan(x.cast("double")))
    return F.transform(kept, lambda x: normalize_number(x))
