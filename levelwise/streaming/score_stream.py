"""Scoring an unbounded stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from levelwise.operators.requests import score_requests
from levelwise.sources.exchange import parse_requests


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Requests from a folder of JSON lines, as a stream; malformed lines stay in it."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_requests(reader.text(path))


def score_stream(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Start scoring a stream of ``request_id, sentences, raw`` into a file sink.

    The plan is the one :func:`score_requests` builds for a table. It keeps no
    state, so no watermark is needed; the sink and its checkpoint make the
    output exactly-once across restarts.
    """
    writer = (
        score_requests(requests, score)
        .writeStream.format(fmt)
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
