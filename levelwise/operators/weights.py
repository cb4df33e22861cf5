"""Class statistics and imbalance weights.

The windows over everything here only ever see an aggregate: one row per label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, levels_table
from levelwise.functions.measures import pct_of_total, ratio

# Default power scaling and smoothing term.
ALPHA = 0.5
EPSILON = 1e-5


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def counts_with_pct(df: DataFrame, key: str) -> DataFrame:
    """Rows per ``key`` and their percentage of all rows (one decimal)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # The total is one value: keys of any number stay spread.
    return counts.withColumn("pct", pct_of_total(F.col("n"), counts.agg(F.sum("n")).scalar()))


def class_ratios(df: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Observed label ids with their count and share."""
    counts = df.groupBy(label_id).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def class_weights(
    df: DataFrame,
    label_id: str = "label_id",
    levels: Sequence[str] = LEVELS,
    alpha: float = ALPHA,
    epsilon: float = EPSILON,
) -> DataFrame:
    """One weight per level: ``(r^alpha / sum r^alpha) / (r + epsilon)``.

    Normalised over observed labels only; an unobserved level weighs 1.0.
    One map-side-combined count, then arithmetic on at most ``len(levels)`` rows.
    """
    powered = class_ratios(df, label_id).withColumn("powered", F.pow("ratio", F.lit(float(alpha))))
    observed = powered.select(
        F.col(label_id).alias("label_id"),
        (
            F.col("powered") / F.sum("powered").over(Window.partitionBy()) / (F.col("ratio") + F.lit(float(epsilon)))
        ).alias("weight"),
    )
    return (
        levels_table(df.sparkSession, levels)
        .join(F.broadcast(observed), "label_id", "left")
        .select("label_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    )


def attach_class_weight(df: DataFrame, weights: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Add each row's class weight. ``weights`` has one row per level."""
    keyed = weights.select(F.col("label_id").alias(label_id), "weight")
    return df.join(F.broadcast(keyed), label_id, "left")
