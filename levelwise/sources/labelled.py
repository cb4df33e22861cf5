"""Labelled text tables: CSV or Parquet with a ``text`` and a ``label`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, encode_labels
from levelwise.functions.text import null_as_text
from levelwise.sources.records import read_split_csv
from levelwise.sources.staging import stage


class DatasetNotFound(FileNotFoundError):
    """The labelled data is not where it should be."""


def read_labelled(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    text: str = "text",
    label: str = "label",
    id_col: str = "id",
    multi_line: bool | str = True,
    na_values: Sequence[str] = (),
) -> DataFrame:
    """``id, text, label`` from a file; columns are found by name, others ignored.

    A CSV field may hold quotes and newlines. Spark reads such a file in one
    task; ``multi_line="split"`` reads it in any number of splits
    (:func:`levelwise.sources.records.read_split_csv`), and ``False`` suits CSV
    without embedded newlines. ``na_values`` lists texts to read as NULL; by default only
    an empty field is. A file without ``id_col`` gets generated ids. Those
    would change with the file splits from one scan to the next, so such a table
    is staged once, as Parquet, and read from there.
    """
    fmt = fmt or _format_of(path)
    try:
        if fmt == "csv" and multi_line == "split":
            raw = read_split_csv(spark, path)
        elif fmt == "csv":
            raw = (
                spark.read.option("header", True)
                .option("multiLine", multi_line)
                .option("escape", '"')
                .csv(path)
            )
        else:
            raw = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"labelled data not found: {path}") from error
        raise
    missing = [name for name in (text, label) if name not in raw.columns]
    if missing:
        raise ValueError(f"labelled data at {path} has no column {missing}; found {raw.columns}")
    has_id = id_col in raw.columns
    row_id = F.col(id_col).cast("long") if has_id else F.monotonically_increasing_id()
    content = F.col(text).cast("string")
    if na_values:
        content = F.when(~content.isin(*na_values), content)
    rows = raw.select(row_id.alias("id"), content.alias("text"), F.col(label).cast("string").alias("label"))
    return rows if has_id else stage(rows, "labelled")


def _format_of(path: str) -> str:
    name = path.rstrip("/").lower()
    for fmt in ("parquet", "csv"):
        if name.endswith((f".{fmt}", f".{fmt}.gz")):
            return fmt
    raise ValueError(f"the name of {path} does not tell its format: pass fmt")


def prepare_labelled(
    df: DataFrame,
    levels: Sequence[str] = LEVELS,
    on_unknown: str = "error",
    null_text: str = "drop",
) -> DataFrame:
    """Add ``label_id`` and settle NULL text.

    ``null_text='drop'`` removes such rows (:func:`null_text_count` says how
    many), ``'nan'`` keeps them as the word ``nan``.
    """
    if null_text not in ("drop", "nan"):
        raise ValueError(f"null_text must be 'drop' or 'nan', got {null_text!r}")
    if null_text == "drop":
        df = df.where(F.col("text").isNotNull())
    else:
        df = df.withColumn("text", null_as_text("text"))
    return encode_labels(df, "label", "label_id", levels, on_unknown)


def null_text_count(df: DataFrame) -> DataFrame:
    """One row: rows in all and rows without text.

    Reads the text column's nulls only. (An ``Observation`` would save this
    pass, but its session state breaks the serialisation of fitted two-class
    models afterwards.)
    """
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("text").isNull(), F.lit(1))).alias("null_text"))
