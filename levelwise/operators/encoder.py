"""Encoders of the caller's own: a function from a column to vectors, loaded once per Python worker.

``load`` is called in a worker and returns the encoder, a function from an Arrow array (texts, or whatever the column
holds) to a matrix with one row per value. Loading may be slow: a worker keeps the encoder for all tasks it runs.
Rows pass in batches of a fixed number, whatever the sizes of Spark's own batches, so an encoder that depends on the
batch size sees the same one everywhere. Rows are neither shuffled nor gathered, for tables as for streams.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from levelwise.functions.labels import LEVELS
from levelwise.operators.score import score_linear

Encode = Callable[[pa.Array], np.ndarray]
BATCH_ROWS = 1024


@dataclass(frozen=True)
class Encoder:
    """How to get an encoder and what it returns; ``key`` names it within a worker."""

    load: Callable[[], Encode]
    dim: int
    batch_rows: int = BATCH_ROWS
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.dim < 1 or self.batch_rows < 1:
            raise ValueError("dim and batch_rows must be positive")


def per_worker(key: str, load: Callable[[], object]) -> object:
    """What ``load`` returns, made once per process."""
    # A module of its own outlives the functions that Spark sends anew with every task.
    kept = sys.modules.setdefault("_kept_per_worker", types.ModuleType("_kept_per_worker"))
    if not hasattr(kept, key):
        setattr(kept, key, load())
    return getattr(kept, key)


def encode_with(df: DataFrame, encoder: Encoder, column: str = "sentence", output: str = "features") -> DataFrame:
    """``df`` with the vectors of ``column``. A null value has a null vector and is not passed to the encoder."""
    if output in df.columns:
        raise ValueError(f"there is a column {output} already")
    schema = StructType([*df.schema.fields, StructField(output, ArrayType(DoubleType()))])
    load, dim, rows, key = encoder.load, encoder.dim, encoder.batch_rows, encoder.key

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = None, []

        def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal encode
            encode = encode or per_worker(key, load)
            values = batch.column(batch.schema.get_field_index(column))
            known = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
            matrix = np.asarray(encode(values.take(pa.array(known))), "float64") if len(known) else np.zeros((0, dim))
            if matrix.shape != (len(known), dim):
                raise ValueError(f"the encoder returned {matrix.shape}, expected {(len(known), dim)}")
            lengths = np.zeros(len(values), "int32")
            lengths[known] = dim
            ends = np.concatenate(([0], np.cumsum(lengths))).astype("int32")
            column_out = pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()), mask=pa.array(lengths == 0))
            return pa.RecordBatch.from_arrays([*batch.columns, column_out], names=[*batch.schema.names, output])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                for part in whole.slice(0, rows).combine_chunks().to_batches():
                    yield finish(part)
                held = whole.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            for part in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield finish(part)

    return df.mapInArrow(vectors, schema)


def score_encoded(
    df: DataFrame, encoder: Encoder, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None,
    column: str = "sentence", levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Add ``pred_id, cefr, confidence``: a linear head over the caller's encoder.

    Serves as the ``score`` of :func:`levelwise.operators.requests.score_requests` and of streams.
    """
    return score_linear(encode_with(df, encoder, column, "_encoded"), weights, bias, "_encoded", levels).drop("_encoded")


def embedding_projection(weights: Sequence[Sequence[float]]) -> Encoder:
    """An encoder that maps vectors of a table linearly: one output per row of ``weights``."""
    fixed = [list(map(float, row)) for row in weights]

    def load() -> Encode:
        matrix = np.array(fixed).T

        def encode(vectors: pa.Array) -> np.ndarray:
            return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(matrix)).astype("float64") @ matrix

        return encode

    return Encoder(load, len(fixed))
