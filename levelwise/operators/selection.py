"""Choosing the best of a few candidates from their evaluation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def running_best(history: DataFrame, candidate: str = "candidate", score: str = "macro_f1") -> DataFrame:
    """Mark each candidate that beats all earlier ones (and zero).

    ``history`` has one row per candidate tried, so a single ordered window
    over it is bounded by the number of fits.
    """
    earlier = Window.orderBy(candidate).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max(score).over(earlier), F.lit(0.0))
    return history.withColumn("best_before", best).withColumn("is_best", F.col(score) > F.col("best_before"))


def select_best(history: DataFrame, candidate: str = "candidate", score: str = "macro_f1") -> DataFrame:
    """The winning candidate: highest score above zero, the earliest on ties.

    No row when nothing scored above zero.
    """
    return history.where(F.col(score) > 0).orderBy(F.desc(score), candidate).limit(1)
