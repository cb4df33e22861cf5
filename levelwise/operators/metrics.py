"""Evaluation metrics, all derived from one aggregate.

``confusion_cells`` reduces the scored rows to at most ``len(levels) ** 2``
rows with a map-side-combined count. Every other metric is arithmetic on that
table, so the rows are read once however many metrics are wanted and a
dominant class costs no more than a rare one. Broadcast sides here are such
aggregates: one row per level, or one per pair of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, levels_table
from levelwise.functions.measures import BANDS, confidence_band, pct_of_total, ratio, signed_diff
from levelwise.functions.scoring import correct_flag

# Names of the report's summary rows.
ACCURACY, MACRO, WEIGHTED = "accuracy", "macro avg", "weighted avg"

LOSS_FLOOR = 1e-15


def confusion_cells(
    df: DataFrame, truth: str = "y", predicted: str = "p", by: Sequence[str] = (), levels: Sequence[str] = LEVELS,
    outside: str = "error",
) -> DataFrame:
    """Non-empty cells ``(y, p, n)``, optionally per group of ``by``.

    Every metric starts here, so all of them see the same labels: one that is
    NULL or no index of ``levels`` fails the job, or with ``outside="drop"``
    leaves its row out (:func:`outside_count` tells how many).
    """
    if outside not in ("error", "drop"):
        raise ValueError("outside must be 'error' or 'drop'")
    if outside == "drop":
        df = df.where(_inside(truth, len(levels)) & _inside(predicted, len(levels)))
    y = checked_truth(truth, predicted, levels)
    return df.groupBy(*by, y.alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def checked_truth(truth: str = "y", predicted: str = "p", levels: Sequence[str] = LEVELS) -> Column:
    """The true label; a row where it or the prediction is NULL or no index of ``levels`` fails the job."""
    known = _inside(truth, len(levels)) & _inside(predicted, len(levels))
    pair = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in (truth, predicted)])
    return F.when(known, F.col(truth)).otherwise(F.raise_error(F.concat(F.lit("label outside the levels: "), pair)))


def outside_count(df: DataFrame, truth: str = "y", predicted: str = "p", levels: Sequence[str] = LEVELS) -> DataFrame:
    """``n, outside``: rows, and those whose truth or prediction is NULL or no index of ``levels``."""
    known = _inside(truth, len(levels)) & _inside(predicted, len(levels))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~known, 1)).alias("outside"))


def _inside(label: str, n: int) -> Column:
    return F.coalesce((F.col(label) >= 0) & (F.col(label) < n), F.lit(False))


def confusion_matrix(cells: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Dense long matrix: one row per (true, predicted) pair of levels."""
    ids = F.array(*[F.lit(i) for i in range(len(levels))])
    grid = levels_table(cells.sparkSession, levels).select(
        F.col("label_id").alias("true_id"), F.explode(ids).alias("pred_id")
    )
    found = cells.select(F.col("y").alias("true_id"), F.col("p").alias("pred_id"), "n")
    return grid.join(F.broadcast(found), ["true_id", "pred_id"], "left").select(
        "true_id", "pred_id", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(cells: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """The matrix for display: one row per true level, one column per predicted level."""
    dense = confusion_matrix(cells, levels)
    counts = [F.sum(F.when(F.col("pred_id") == i, F.col("n"))).alias(level) for i, level in enumerate(levels)]
    code = F.get(F.array(*[F.lit(level) for level in levels]), F.col("true_id"))
    return dense.groupBy("true_id").agg(*counts).orderBy("true_id").select(code.alias("true_level"), *levels)


def class_stats(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label seen in truth or predictions: hits, support and predicted count."""
    hits = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    views = F.explode(F.array(
        F.struct(F.col("y").alias("label_id"), F.col("n").alias("support"), zero.alias("predicted"),
                 hits.cast("long").alias("tp")),
        F.struct(F.col("p").alias("label_id"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")),
    ))
    return (
        cells.select(*by, views.alias("v"))
        .groupBy(*by, F.col("v.label_id").alias("label_id"))
        .agg(
            F.sum("v.tp").alias("tp"),
            F.sum("v.support").alias("support"),
            F.sum("v.predicted").alias("predicted"),
        )
    )


def accuracy(cells: DataFrame) -> DataFrame:
    """One row: rows, correct rows and their share (NULL when there are none)."""
    hits = F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return cells.agg(hits.alias("correct"), total.alias("n")).select(
        "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy")
    )


def macro_f1(cells: DataFrame, present_only: bool = True, levels: Sequence[str] = LEVELS) -> DataFrame:
    """One row: unweighted mean F1.

    ``present_only=True`` averages over labels that occur in the truth or the
    predictions; ``False`` over all levels, absent ones counting zero.
    """
    f1 = _f1()
    total = F.sum(f1)
    divisor = F.count(F.lit(1)) if present_only else F.lit(len(levels))
    return class_stats(cells).agg(F.when(F.count(F.lit(1)) > 0, ratio(total, divisor)).alias("macro_f1"))


def evaluate_table(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, macro_f1`` (labels present), one row or one row per group."""
    stats = class_stats(cells, by)
    grouped = stats.groupBy(*by) if by else stats
    return grouped.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(_f1()).alias("macro_f1"),
    )


def classification_report(cells: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Per-level precision, recall, F1 and support plus three summary rows.

    Each level row contributes to its own line and to the three summaries in
    one aggregation, so the cells are computed once. Empty denominators give
    zero. The macro row averages over all levels.
    """
    stats = class_stats(cells)
    rows = levels_table(cells.sparkSession, levels).join(F.broadcast(stats), "label_id", "left").select(
        "label_id",
        "code",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "support", "predicted")],
    )
    rows = rows.select(
        "*", _precision().alias("precision"), _recall().alias("recall"), _f1().alias("f1")
    )
    one, support = F.lit(1.0), F.col("support").cast("double")
    k = len(levels)

    def line(position: Column, name: Column, weight: Column) -> Column:
        return F.struct(position.alias("position"), name.alias("name"), weight.alias("weight"))

    lines = F.explode(F.array(
        line(F.col("label_id"), F.col("code"), one),
        line(F.lit(k), F.lit(ACCURACY), support),
        line(F.lit(k + 1), F.lit(MACRO), one),
        line(F.lit(k + 2), F.lit(WEIGHTED), support),
    ))
    w = F.col("line.weight")
    total = F.sum(w)

    def averaged(column: str) -> Column:
        return ratio(F.sum(F.col(column) * w), total, 0.0)

    summed = rows.select("*", lines.alias("line")).groupBy(
        F.col("line.position").alias("position"), F.col("line.name").alias("name")
    ).agg(
        averaged("precision").alias("precision"),
        averaged("recall").alias("recall"),
        averaged("f1").alias("f1"),
        ratio(F.sum("tp"), F.sum("support"), 0.0).alias("hit_share"),
        F.sum("support").alias("support"),
    )
    is_accuracy = F.col("name") == ACCURACY
    return summed.select(
        "position",
        "name",
        F.when(~is_accuracy, F.col("precision")).alias("precision"),
        F.when(~is_accuracy, F.col("recall")).alias("recall"),
        F.when(is_accuracy, F.col("hit_share")).otherwise(F.col("f1")).alias("f1"),
        "support",
    ).orderBy("position")


def per_class_perf(cells: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Accuracy within the class, precision and recall of classes present in the truth."""
    code = F.get(F.array(*[F.lit(level) for level in levels]), F.col("label_id"))
    return class_stats(cells).where(F.col("support") > 0).select(
        "label_id",
        code.alias("level"),
        # Hits among the rows of the class: the same number as recall.
        _recall().alias("class_accuracy"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        "support",
    ).orderBy("label_id")


def class_distribution(cells: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """True and predicted rows of every level with their signed difference."""
    stats = class_stats(cells).select("label_id", "support", "predicted")
    zero = F.lit(0).cast("long")
    return (
        levels_table(cells.sparkSession, levels)
        .join(F.broadcast(stats), "label_id", "left")
        .select(
            "label_id",
            F.col("code").alias("level"),
            F.coalesce("support", zero).alias("n_true"),
            F.coalesce("predicted", zero).alias("n_pred"),
        )
        .withColumn("diff", F.col("n_pred") - F.col("n_true"))
        .withColumn("diff_text", signed_diff(F.col("n_pred"), F.col("n_true")))
        .orderBy("label_id")
    )


def confidence_stats(df: DataFrame, confidence: str = "confidence", truth: str = "y", predicted: str = "p") -> DataFrame:
    """Mean and population deviation of confidence: all, correct, incorrect rows.

    One pass, no shuffle of rows; a side without rows is NULL.
    """
    right, c = correct_flag(predicted, truth), F.col(confidence)
    sides = {"overall": c, "correct": F.when(right, c), "incorrect": F.when(~right, c)}
    aggs = []
    for name, value in sides.items():
        aggs += [
            F.count(value).alias(f"n_{name}"),
            F.avg(value).alias(f"mean_{name}"),
            F.stddev_pop(value).alias(f"std_{name}"),
        ]
    return df.agg(*aggs)


def confidence_buckets(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Rows and percentage per confidence band; all three bands are shown."""
    band = confidence_band(F.col(confidence))
    totals = df.agg(
        F.count(F.col(confidence)).alias("total"),
        *[F.count(F.when(band == name, F.lit(1))).alias(name) for name in BANDS],
    )
    shown = F.explode(F.array(*[F.struct(F.lit(name).alias("band"), F.col(name).alias("n")) for name in BANDS]))
    return totals.select("total", shown.alias("b")).select(
        "b.band", "b.n", pct_of_total(F.col("b.n"), F.col("total")).alias("pct")
    )


def error_count(cells: DataFrame) -> DataFrame:
    """One row: number of misclassified rows."""
    wrong = F.sum(F.when(F.col("y") != F.col("p"), F.col("n")))
    return cells.agg(F.coalesce(wrong, F.lit(0)).alias("n_errors"))


def weighted_log_loss(df: DataFrame, p_true: Column | str = "p_true", weight: Column | str = "weight") -> DataFrame:
    """One row: weighted mean of the negative log probability of the true class."""
    p_true = F.col(p_true) if isinstance(p_true, str) else p_true
    weight = F.col(weight) if isinstance(weight, str) else weight
    loss = -F.log(F.greatest(p_true, F.lit(LOSS_FLOOR)))
    return df.agg(ratio(F.sum(weight * loss), F.sum(weight)).alias("log_loss"))


def _precision() -> Column:
    return ratio(F.col("tp"), F.col("predicted"), 0.0)


def _recall() -> Column:
    return ratio(F.col("tp"), F.col("support"), 0.0)


def _f1() -> Column:
    return ratio(F.col("tp") * 2, F.col("support") + F.col("predicted"), 0.0)
