"""Predictions of a stream, written once per micro-batch whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from levelwise.sources.exchange import prediction_records

BATCH = "batch_id"


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/{BATCH}={batch_id}"


def keyed_writer(path: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes ``shape(rows)`` to the folder of the batch.

    A batch that is run again after a crash replaces its own folder and touches no other, so its rows are there once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        shape(rows).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def start_keyed(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Start writing a stream by batch; the checkpoint numbers the batches."""
    writer = stream.writeStream.foreachBatch(keyed_writer(path, shape)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def sink_predictions(
    scored: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...] = ("request_id", "pos"), available_now: bool = True,
) -> StreamingQuery:
    """Start writing the prediction records of a scored stream; refused requests have none.

    Readers see them as Parquet with the batch as a partition column.
    """
    return start_keyed(scored, path, checkpoint, lambda rows: prediction_records(rows, keep), available_now)
