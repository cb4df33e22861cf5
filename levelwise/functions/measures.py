"""Small numeric and display expressions shared by the metric operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges (exclusive) of the confidence bands.
HIGH_ABOVE = 0.8
MEDIUM_ABOVE = 0.6
BANDS = ("high", "medium", "low")


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Double division; ``otherwise`` where the denominator is zero."""
    return F.when(
        denominator != 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(otherwise).cast("double"))


def pct_of_total(n: Column, total: Column, digits: int = 1) -> Column:
    """``n`` as a percentage of ``total``; NULL for an empty total."""
    return F.round(ratio(n.cast("double") * F.lit(100.0), total), digits)


def signed_diff(predicted: Column, truth: Column) -> Column:
    """Difference as text, with ``+`` in front of positive values."""
    diff = predicted - truth
    return F.when(diff > 0, F.concat(F.lit("+"), diff.cast("string"))).otherwise(diff.cast("string"))


def confidence_band(confidence: Column) -> Column:
    """``high`` above 0.8, ``medium`` above 0.6 up to 0.8, ``low`` otherwise."""
    return (
        F.when(confidence > HIGH_ABOVE, F.lit("high"))
        .when(confidence > MEDIUM_ABOVE, F.lit("medium"))
        .when(confidence <= MEDIUM_ABOVE, F.lit("low"))
    )


def fixed_decimals(value: Column, digits: int = 4) -> Column:
    """Fixed-decimal text for display."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
