"""Amounts, quotas and risk bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksift.config import QUOTA_PERCENT


def amount_floor(c: Column) -> Column:
    """Non-negative double; anything unreadable, not a number or infinite is 0."""
    value = c.try_cast("double")
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value).otherwise(F.lit(0.0))


def exact_sum(c: Column) -> Column:
    """Order-independent rupee total: summed as a decimal, cast once."""
    return F.coalesce(F.sum(c.cast("decimal(28,4)")).cast("double"), F.lit(0.0))


def quota_for(n: Column) -> Column:
    """Ten percent rounded up in integers: at least 1 of anything, 0 of nothing."""
    numerator = n.cast("bigint") * F.lit(QUOTA_PERCENT) + F.lit(99)
    return F.call_function("div", numerator, F.lit(100))


def risk_band(score: Column, flags: Column) -> Column:
    return (
        F.when(F.size(flags) == 0, 0)
        .when(score > 75, 4)
        .when(score > 50, 3)
        .when(score > 25, 2)
        .otherwise(1)
    )
