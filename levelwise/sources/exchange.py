"""Request payloads in, prediction records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.text import is_blank

# Ids are text: a number is read as its digits.
REQUEST_SCHEMA = "request_id string, sentences array<string>"
# The line of a request that is no such object; NULL for all others.
RAW = "raw"

# Fields of a prediction record, in order.
PREDICTION_FIELDS = ("cefr", "sentence", "confidence")


def parse_requests(lines: DataFrame, line: str = "value") -> DataFrame:
    """``request_id, sentences, raw`` from JSON lines, blank ones left out.

    A line that is not JSON or whose fields have other types keeps its text in
    ``raw``, so that it can be answered. Row-wise: serves tables and streams.
    """
    parsed = F.from_json(line, f"{REQUEST_SCHEMA}, {RAW} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
    request = lines.where(~is_blank(line)).select(F.col(line).alias("_line"), parsed.alias("_r"))
    return request.select("_r.request_id", "_r.sentences", F.when(F.col("_r").isNull(), F.col("_line")).otherwise(F.col(f"_r.{RAW}")).alias(RAW))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, sentences, raw`` from files of JSON lines (splittable)."""
    return parse_requests(spark.read.text(path))


def prediction_records(scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The record fields of scored rows; refused requests have none."""
    rows = scored.where(F.col("cefr").isNotNull()) if "status" in scored.columns else scored
    return rows.select(*keep, *PREDICTION_FIELDS)


def write_predictions(
    scored: DataFrame, path: str, fmt: str = "parquet", keep: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """Write prediction records as Parquet or JSON."""
    prediction_records(scored, keep).write.mode(mode).format(fmt).save(path)


def request_payloads(requests: DataFrame) -> DataFrame:
    """Requests as JSON text, one object per row."""
    return requests.select(F.to_json(F.struct("request_id", "sentences")).alias("value"))
