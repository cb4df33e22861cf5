"""Ordered level labels and the string <-> integer mapping between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered level codes with their published names and
# one-line descriptions.
LEVEL_INFO = (
    ("A1", "Beginner", "Basic everyday expressions and very simple phrases"),
    ("A2", "Elementary", "Simple sentences on familiar topics and routine matters"),
    ("B1", "Intermediate", "Clear communication on familiar matters and personal interests"),
    ("B2", "Upper Intermediate", "Complex texts and abstract topics with good fluency"),
    ("C1", "Advanced",
     "Flexible and effective language use for social, academic and professional purposes"),
    ("C2", "Proficient",
     "Very high level with precise, nuanced expression and full command of language"),
)

LEVELS = tuple(code for code, _, _ in LEVEL_INFO)

UNKNOWN_MODES = ("error", "drop")


def levels_array(levels: Sequence[str] = LEVELS) -> Column:
    return F.array(*[F.lit(level) for level in levels])


def label_to_id(label: Column | str, levels: Sequence[str] = LEVELS) -> Column:
    """Level code -> position in ``levels``; NULL for anything outside the list."""
    position = F.array_position(levels_array(levels), F.col(label) if isinstance(label, str) else label)
    return F.when(position > 0, (position - 1).cast("int"))


def id_to_label(label_id: Column | str, levels: Sequence[str] = LEVELS) -> Column:
    """Position -> level code; NULL outside the range."""
    label_id = F.col(label_id) if isinstance(label_id, str) else label_id
    return F.get(levels_array(levels), label_id.cast("int"))


def encode_labels(
    df: DataFrame,
    label: str = "label",
    out: str = "label_id",
    levels: Sequence[str] = LEVELS,
    on_unknown: str = "error",
) -> DataFrame:
    """Add the integer label.

    ``on_unknown='error'`` fails the job that reads the column and names the
    value; ``'drop'`` removes the row. A label never becomes NULL silently.
    """
    if on_unknown not in UNKNOWN_MODES:
        raise ValueError(f"on_unknown must be one of {UNKNOWN_MODES}, got {on_unknown!r}")
    label_id = label_to_id(label, levels)
    if on_unknown == "drop":
        return df.withColumn(out, label_id).where(F.col(out).isNotNull())
    problem = F.concat(F.lit("unknown label: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    return df.withColumn(out, F.coalesce(label_id, F.raise_error(problem).cast("int")))


def levels_table(spark: SparkSession, levels: Sequence[str] = LEVELS) -> DataFrame:
    """One row per level: ``label_id, code``. Its size is ``len(levels)``."""
    schema = T.StructType([
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("code", T.StringType(), False),
    ])
    return spark.createDataFrame(list(enumerate(levels)), schema).coalesce(1)


def levels_dim(spark: SparkSession) -> DataFrame:
    """The six levels with their names and descriptions."""
    schema = T.StructType([
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("code", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
    ])
    return spark.createDataFrame([(i, *info) for i, info in enumerate(LEVEL_INFO)], schema).coalesce(1)


def attach_level_info(df: DataFrame, code: str = "cefr") -> DataFrame:
    """Name and description of each row's level code (six-row broadcast join)."""
    info = levels_dim(df.sparkSession).drop("label_id").withColumnRenamed("code", code)
    return df.join(F.broadcast(info), code, "left")
