"""The full evaluation report from one pass over the scored rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS
from levelwise.functions.measures import fixed_decimals, BANDS, confidence_band, pct_of_total, ratio
from levelwise.operators import metrics
from levelwise.operators.errors import MAX_SAMPLES, top_errors

SUMMARY_SCHEMA = "y int, p int, n long, mean double, var double, high long, medium long, low long"


def summarise(scored: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """At most ``levels x levels`` rows that hold all the report needs.

    Each cell carries its count, the mean and population variance of its
    confidences and its count per confidence band.
    """
    band = confidence_band(F.col("confidence"))
    return scored.groupBy(metrics.checked_truth(levels=levels).alias("y"), "p").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean"),
        F.var_pop("confidence").alias("var"),
        *[F.count(F.when(band == name, F.lit(1))).alias(name) for name in BANDS],
    )


def evaluation_report(
    scored: DataFrame, levels: Sequence[str] = LEVELS, max_samples: int = MAX_SAMPLES, text: str = "text"
) -> dict[str, DataFrame]:
    """The report's parts by name.

    ``scored`` has ``id, y, p, confidence`` and the text or its preview. The cell summary is
    aggregated once and kept (its size is bounded by the level count); only the
    list of sample errors reads the rows again, as a top-k.
    """
    spark = scored.sparkSession
    cells = spark.createDataFrame([tuple(r) for r in summarise(scored, levels).collect()], SUMMARY_SCHEMA).coalesce(1)
    return {
        "overall": metrics.evaluate_table(cells),
        "classification_report": metrics.classification_report(cells, levels),
        "confusion_matrix": metrics.confusion_matrix(cells, levels),
        "per_class_perf": metrics.per_class_perf(cells, levels),
        "confidence_stats": _confidence_stats(cells),
        "confidence_buckets": _confidence_buckets(cells),
        "error_count": metrics.error_count(cells),
        "top_errors": top_errors(scored, text=text, max_samples=max_samples, levels=levels),
        "class_distribution": metrics.class_distribution(cells, levels),
    }


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The numeric parts as one long table: ``section, item, measure, value``."""
    matrix = report["confusion_matrix"].select(
        F.concat_ws("-", "true_id", "pred_id").alias("cell"), "n"
    )
    parts = [
        _long(report["overall"], "overall", F.lit("all"), ("n", "accuracy", "macro_f1")),
        _long(report["classification_report"], "classification_report", F.col("name"),
              ("precision", "recall", "f1", "support")),
        _long(matrix, "confusion_matrix", F.col("cell"), ("n",)),
        _long(report["per_class_perf"], "per_class_perf", F.col("level"), ("class_accuracy", "precision", "recall")),
        _long(report["confidence_stats"], "confidence_stats", F.col("side"), ("n", "mean", "std")),
        _long(report["confidence_buckets"], "confidence_buckets", F.col("band"), ("n", "pct")),
        _long(report["error_count"], "error_count", F.lit("all"), ("n_errors",)),
        _long(report["class_distribution"], "class_distribution", F.col("level"), ("n_true", "n_pred", "diff")),
    ]
    return reduce(DataFrame.unionByName, parts)


def formatted_report(report: DataFrame, digits: int = 4) -> DataFrame:
    """The class report for display: names and fixed decimals in report order, an empty text where there is no number."""
    shown = [F.when(F.col(c).isNull(), "").otherwise(fixed_decimals(F.col(c), digits)).alias(c) for c in ("precision", "recall", "f1")]
    return report.orderBy("position").select("position", "name", *shown, F.col("support").cast("string").alias("support"))


def _long(df: DataFrame, section: str, item: Column, measures: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures
    ]))
    return df.select(F.lit(section).alias("section"), item.alias("item"), pairs.alias("m")).select(
        "section", "item", "m.measure", "m.value"
    )


def _confidence_stats(cells: DataFrame) -> DataFrame:
    """Mean and population deviation per side, merged from the cells.

    The variance of a union of groups is the mean of their variances plus the
    variance of their means, both weighted by group size.
    """
    by_side = Window.partitionBy("side")
    right = F.col("y") == F.col("p")
    sides = cells.select(
        F.explode(F.array(F.lit("overall"), F.when(right, F.lit("correct")).otherwise(F.lit("incorrect")))).alias("side"),
        "n", "mean", "var",
    )
    total = F.sum("n").over(by_side)
    centred = sides.withColumn("all_mean", ratio(F.sum(F.col("n") * F.col("mean")).over(by_side), total))
    spread = F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("all_mean"), F.lit(2.0))))
    found = centred.groupBy("side").agg(
        F.sum("n").alias("n"), F.first("all_mean").alias("mean"), F.sqrt(ratio(spread, F.sum("n"))).alias("std")
    )
    names = cells.sparkSession.createDataFrame([("overall",), ("correct",), ("incorrect",)], "side string").coalesce(1)
    return names.join(F.broadcast(found), "side", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _confidence_buckets(cells: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.coalesce(F.col(b), F.lit(0)).alias("n")) for b in BANDS]))
    totals = cells.agg(*[F.sum(b).alias(b) for b in BANDS])
    total = sum((F.coalesce(F.col(b), F.lit(0)) for b in BANDS), F.lit(0))
    return totals.select(total.alias("total"), pairs.alias("b")).select(
        "b.band", "b.n", pct_of_total(F.col("b.n"), F.col("total")).alias("pct")
    )
