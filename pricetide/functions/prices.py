"""Price, return and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def used_price(primary: Column, fallback: Column) -> Column:
    """Primary price, else the fallback. Only NULL falls back: a zero stays zero."""
    return F.coalesce(primary, fallback).cast("double")


def usable(price: Column) -> Column:
    """The price when it is a positive finite number, else NULL."""
    return F.when(~F.isnan(price) & (price > 0) & (price < F.lit(float("inf"))), price)


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL (Spark's least/greatest skip NULLs)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def capped_return(raw: Column, cap: float) -> Column:
    return clip(raw, -cap, cap)


def is_spike(raw: Column, used: Column) -> Column:
    return F.abs(used - raw) > F.lit(1e-15)


def inverse_dispersion(low: Column, avg: Column) -> Column:
    """1 - clipped relative gap between low and average price; 0 when unknown."""
    gap = F.abs(low - avg) / F.when(avg > 0, avg)
    return F.coalesce(1.0 - clip(gap, 0.0, 1.0), F.lit(0.0))


def ratio(part: Column, whole: Column, places: int = 8) -> Column:
    """Rounded share; 0 when the whole is 0 or unknown."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), places)


def budget_status(usage: Column) -> Column:
    return (
        F.when(usage > 1, "over_free_tier")
        .when(usage >= 0.8, "warning")
        .otherwise("within_free_tier")
    )
