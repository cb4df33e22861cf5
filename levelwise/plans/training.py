"""The whole job: split, fit, score the test rows, report, sample predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.scoring import argmax_label, confidence
from levelwise.functions.text import text_preview
from levelwise.operators.metrics import confusion_cells, evaluate_table
from levelwise.operators.score import score_table
from levelwise.operators.split import SEED, assign_split, split_cuts
from levelwise.operators.weights import counts_with_pct
from levelwise.plans.fit import FitSettings, FittedClassifier, fit_counted, score_counted, word_counts
from levelwise.plans.report import evaluation_report
from levelwise.sources.exchange import prediction_records
from levelwise.sources.labelled import prepare_labelled, read_labelled
from levelwise.sources.staging import stage, staged

# Sample sentences, scored after a training run.
DEMO_TEXTS = (
    "My dog is big.",
    "We went to the market because it was sunny.",
    "Had the bridge been repaired in time, the detour would not have been necessary.",
    "Notwithstanding its brevity, the treatise unsettles several cherished assumptions.",
)


@dataclass(frozen=True)
class TrainingRun:
    fitted: FittedClassifier
    split_sizes: DataFrame
    scored_test: DataFrame
    report: dict[str, DataFrame]
    demo: DataFrame


def split_labelled(labelled: DataFrame, seed: int = SEED, settings: FitSettings = FitSettings(),
                   allow_rare: bool = False) -> DataFrame:
    """``id, text, label_id, split``.

    Only the cut points (one row per level) are computed here and kept; the
    text is not copied. Reading a part scans the source and compares keys.
    """
    rows = labelled.select("id", "text", "label_id")
    cuts = split_cuts(rows, seed=seed, levels=settings.levels, allow_rare=allow_rare)
    kept = labelled.sparkSession.createDataFrame(cuts.collect(), cuts.schema).coalesce(1)
    return assign_split(rows, kept, seed=seed)


def score_labelled(fitted: FittedClassifier, rows: DataFrame) -> DataFrame:
    """Labelled rows with prediction: ``id, text, y, p, confidence``."""
    scored = score_table(fitted.model, rows.select("id", "text", "label_id"), "text", fitted.settings.levels)
    return scored.select(
        "id", "text", F.col("label_id").alias("y"), F.col("pred_id").alias("p"), "confidence"
    )


def evaluate_classifier(fitted: FittedClassifier, rows: DataFrame) -> DataFrame:
    """``n, accuracy, macro_f1`` of a fitted model on ``id, text, label_id`` rows."""
    return evaluate_table(confusion_cells(score_labelled(fitted, rows), levels=fitted.settings.levels))


def demo_predictions(spark: SparkSession, fitted: FittedClassifier) -> DataFrame:
    """Prediction records of the sample sentences."""
    rows = spark.createDataFrame(list(enumerate(DEMO_TEXTS)), "pos int, sentence string").coalesce(1)
    return prediction_records(score_table(fitted.model, rows, levels=fitted.settings.levels), ("pos",))


def train_and_evaluate(
    labelled: DataFrame, settings: FitSettings = FitSettings(), seed: int = SEED, allow_rare: bool = False
) -> TrainingRun:
    """Split 70/15/15, fit and select on train/val, report on test.

    ``labelled`` has ``id, text, label_id``. The text is read once: the word
    counts of all parts are staged, the fit and the scores of the test rows come
    from them, and they are removed at the end. The scored test rows stay staged
    with a preview of their text; the report and the returned table read that.
    """
    return _run(split_labelled(labelled, seed, settings, allow_rare), settings)


def _run(parts: DataFrame, settings: FitSettings) -> TrainingRun:
    """Fit on the parts ``train`` and ``val``, report on ``test``."""
    spark = parts.sparkSession
    with staged(word_counts(parts, settings, ("id", text_preview("text").alias("preview"))), "counts") as counted:
        fitted = fit_counted(counted, settings)
        scored = score_counted(fitted, counted.where(F.col("part") == "test")).select(
            "id", F.col("label_id").alias("y"), argmax_label("probability").alias("p"),
            confidence("probability").alias("confidence"), "preview",
        )
        scored = stage(scored, "scored-test")
    return TrainingRun(
        fitted=fitted,
        split_sizes=counts_with_pct(parts, "split"),
        scored_test=scored,
        report=evaluation_report(scored, settings.levels, text="preview"),
        demo=demo_predictions(spark, fitted),
    )


def train_on_files(
    spark: SparkSession, train_path: str, test_path: str, settings: FitSettings = FitSettings(), seed: int = SEED,
    fmt: str | None = None, allow_rare: bool = False,
) -> TrainingRun:
    """Fit on one labelled file and report on another that was set apart before.

    Candidates are chosen on rows cut from the training file; its share that
    would be a test set trains as well. The text of both files is read once.
    """
    train, test = (prepare_labelled(read_labelled(spark, path, fmt), settings.levels) for path in (train_path, test_path))
    cut = split_labelled(train, seed, settings, allow_rare)
    inside = cut.withColumn("split", F.when(F.col("split") == "val", "val").otherwise("train"))
    parts = inside.unionByName(test.select("id", "text", "label_id").withColumn("split", F.lit("test")), allowMissingColumns=True)
    return _run(parts, settings)
