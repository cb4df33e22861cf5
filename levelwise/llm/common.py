"""Small helpers shared by the operators of this subpackage.

Identity of a document row: ``(_did, _tid)``. ``_did`` is the document id, with
the largest long standing for a null id; ``_tid`` is a fingerprint of the text.
Rows of one id with different texts stay apart; identical rows share results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.sources.staging import stage

NULL_ID = 2**63 - 1
# Largest table, in rows, that operators hint Spark to broadcast.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(NULL_ID)).cast("long")


def from_doc_key(key: str | Column) -> Column:
    """The id that ``doc_key`` was made from."""
    return F.nullif(F.col(key) if isinstance(key, str) else key, F.lit(NULL_ID))


def text_key(text: str | Column = "text") -> Column:
    """Fingerprint of a text; null and empty differ."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(column.isNull(), column)


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z and nothing else."""
    column = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def small_side(table: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table whose counted rows are within ``limit``; Spark joins larger ones by sorting."""
    return F.broadcast(table) if rows <= limit else table.hint("merge")


__all__ = [
    "BROADCAST_ROWS", "NULL_ID", "Query", "ascii_lower", "doc_key", "from_doc_key", "read", "small_side", "stage",
    "text_key",
]
