"""Error analysis and alignment of predictions with their truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, id_to_label
from levelwise.functions.scoring import correct_flag
from levelwise.functions.text import text_preview

# Fixed value: how many sample errors a report lists.
MAX_SAMPLES = 10
# Rows of a bucket of a table that is aligned often.
BUCKET_ROWS = 2_000_000


def align_predictions(truth: DataFrame, predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Truth and predictions of the same id in one row.

    A plain equi-join on a unique id that prunes the text when it is not used.
    Ids on one side only stay: ``missing`` names the absent side and
    ``correct`` is false.
    """
    left = truth.withColumn("_truth", F.lit(True))
    right = predictions.withColumn("_predicted", F.lit(True))
    missing = F.when(F.col("_truth").isNull(), "truth").when(F.col("_predicted").isNull(), "prediction")
    return (
        left.join(right, id_col, "full")
        .withColumns({"correct": F.coalesce(correct_flag("p", "y"), F.lit(False)), "missing": missing})
        .drop("_truth", "_predicted")
    )


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, id_col: str = "id") -> DataFrame:
    """A table of Parquet files below ``path``, dealt into ``buckets`` by id and sorted in each; registered as ``name``.

    Tables of equal bucket numbers are aligned without moving a row again, however often.
    """
    dealt = df.repartition(buckets, F.col(id_col))
    dealt.write.bucketBy(buckets, id_col).sortBy(id_col).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def bucket_count(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Buckets for a table of so many rows."""
    return max(1, -(-rows // per_bucket))


def misclassified(df: DataFrame) -> DataFrame:
    return df.where(~correct_flag("p", "y"))


def top_errors(
    df: DataFrame,
    id_col: str = "id",
    text: str = "text",
    max_samples: int = MAX_SAMPLES,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """The first misclassified rows in id order, with levels and a preview.

    ``text`` may hold previews already: the preview of a preview is itself.
    """
    first = misclassified(df).orderBy(id_col).limit(max_samples)
    return first.select(
        id_col,
        id_to_label("y", levels).alias("true_level"),
        id_to_label("p", levels).alias("predicted_level"),
        text_preview(text).alias("preview"),
    )
