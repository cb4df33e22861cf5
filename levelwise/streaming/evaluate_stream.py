"""Evaluation of a running scorer: predictions now, their truth later.

Predictions (``id, p, at``) and truth (``id, y, at``) are joined as streams. A truth counts if it comes at or after its
prediction and at most ``late`` after it; watermarks on both sides let the join forget what can no longer match, so its
state holds one window of rows, not the history. Every micro-batch adds at most levels x levels confusion cells, keyed
by its number: a replayed batch replaces its own cells. Metrics are those of a table, taken from the summed cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from levelwise.functions.labels import LEVELS
from levelwise.operators.metrics import confusion_cells, evaluate_table
from levelwise.streaming.prediction_sink import BATCH, start_keyed

CELLS = f"y int, p int, n long, {BATCH} long"


def matched(predictions: DataFrame, truth: DataFrame, late: str, disorder: str = "0 seconds") -> DataFrame:
    """``id, y, p`` of predictions whose truth came within ``late``; ``disorder`` is how far events may be out of order.

    Serves tables and streams; without watermarks' help a table's result is the same. Null ids and null times match nothing.
    """
    shown = predictions.select("id", F.col("p"), F.col("at").alias("shown")).withWatermark("shown", disorder)
    known = truth.select(F.col("id").alias("truth_id"), F.col("y"), F.col("at").alias("known")).withWatermark("known", disorder)
    in_time = (F.col("known") >= F.col("shown")) & (F.col("known") <= F.col("shown") + F.expr(f"INTERVAL {late}"))
    return shown.join(known, (F.col("id") == F.col("truth_id")) & in_time).select("id", "y", "p")


def evaluate_stream(
    predictions: DataFrame, truth: DataFrame, path: str, checkpoint: str, late: str = "7 days", disorder: str = "0 seconds",
    levels: Sequence[str] = LEVELS, available_now: bool = True,
) -> StreamingQuery:
    """Start adding up confusion cells of two streams below ``path``."""
    cells = lambda rows: confusion_cells(rows, levels=levels).select(F.col("y").cast("int"), F.col("p").cast("int"), "n").coalesce(1)
    return start_keyed(matched(predictions, truth, late, disorder), path, checkpoint, cells, available_now)


def stream_cells(spark: SparkSession, path: str) -> DataFrame:
    """``y, p, n`` over all batches so far."""
    return spark.read.schema(CELLS).parquet(path).groupBy("y", "p").agg(F.sum("n").alias("n"))


def stream_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """``n, accuracy, macro_f1`` so far."""
    return evaluate_table(stream_cells(spark, path))
