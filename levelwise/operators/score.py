"""Scoring tables: fixed linear heads and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, id_to_label
from levelwise.functions.scoring import argmax_label, balanced_sum, confidence, linear_head


def score_linear(
    df: DataFrame,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
    features: str = "features",
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Add ``pred_id, cefr, confidence`` from a fixed head over a vector column."""
    logits = df.withColumn("_logits", linear_head(features, weights, bias)).withColumn("_peak", F.array_max("_logits"))
    # The largest of the softmax shares: its exponential is one.
    total = balanced_sum([F.exp(F.get("_logits", k) - F.col("_peak")) for k in range(len(weights))])
    return (
        logits.withColumn("pred_id", (F.array_position("_logits", F.col("_peak")) - 1).cast("int"))
        .withColumn("cefr", id_to_label("pred_id", levels))
        .withColumn("confidence", F.lit(1.0) / total)
        .drop("_logits", "_peak")
    )


def score_table(
    model: PipelineModel, df: DataFrame, text: str = "sentence", levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Add ``probability`` (array), ``pred_id, cefr, confidence`` from a fitted model."""
    renamed = df if text == "text" else df.withColumn("text", F.col(text))
    added = [c for c in ("words", "counts", "features", "rawPrediction", "prediction") if c not in df.columns]
    scored = model.transform(renamed).withColumn("probability", vector_to_array("probability"))
    scored = scored.drop(*added) if text == "text" else scored.drop("text", *added)
    return (
        scored.withColumn("pred_id", argmax_label("probability"))
        .withColumn("cefr", id_to_label("pred_id", levels))
        .withColumn("confidence", confidence("probability"))
    )


def predict_text(spark: SparkSession, model: PipelineModel, text: str, levels: Sequence[str] = LEVELS) -> tuple[str, float]:
    """Level and confidence of one text."""
    row = score_table(model, spark.createDataFrame([(text,)], "sentence string"), levels=levels).first()
    return row["cefr"], row["confidence"]
