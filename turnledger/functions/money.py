"""Exact money: whole units of 1e-10 USD, turned into dollars only after summing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnledger.constants import USD_UNITS

_SPLIT = 10**6


def usd(units: Column) -> Column:
    """Row-level units as dollars."""
    return units / F.lit(float(USD_UNITS))


def usd_sum(units: Column) -> Column:
    """Sum of units as dollars, the same whatever the order of the rows.

    Two BIGINT sums (millions and remainder) keep the hash aggregate on
    fixed-width longs and cannot overflow below 9e18 millions of units.
    """
    low = units % F.lit(_SPLIT)
    high = ((units - low) / F.lit(_SPLIT)).cast("bigint")
    total = F.coalesce(F.sum(high), F.lit(0)).cast("decimal(28,0)") * F.lit(_SPLIT).cast("decimal(8,0)")
    total = total + F.coalesce(F.sum(low), F.lit(0)).cast("decimal(28,0)")
    return total.cast("double") / F.lit(float(USD_UNITS))


def units_sum(units: Column) -> Column:
    """Exact sum of units for groups known to stay below 9e18 units (one session or smaller)."""
    return F.coalesce(F.sum(units), F.lit(0))
