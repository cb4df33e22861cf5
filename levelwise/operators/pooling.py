"""Masked mean pooling of token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.scoring import of_length
from levelwise.functions.text import words
from levelwise.operators.encode import word_place

# Fixed value: smallest divisor, so an all-masked group pools to zeros.
MIN_TOKENS = 1e-9
# Numbers in the token vectors that are sent to every executor (1 GB), and gathered at a time in a task.
MAX_NUMBERS, PORTION = 1 << 27, 1 << 20


def mean_pool_nested(vectors: Column | str, mask: Column | str, dim: int) -> Column:
    """Mean of the unmasked vectors of one row (array of vectors plus 0/1 mask)."""
    vectors = (F.col(vectors) if isinstance(vectors, str) else vectors).cast("array<array<double>>")
    mask = (F.col(mask) if isinstance(mask, str) else mask).cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), dim)
    # A missing vector counts as masked, one of another length fails the job.
    mask = F.zip_with(vectors, mask, lambda v, m: F.when(v.isNull(), F.lit(0.0)).otherwise(m))
    vectors = F.transform(vectors, lambda v: F.coalesce(of_length(v, dim, v), zeros))
    masked = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    summed = F.aggregate(masked, zeros, lambda total, v: F.zip_with(total, v, add))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), add), F.lit(MIN_TOKENS))
    # A one-element array binds the divisor, so it is computed once per row.
    return F.element_at(F.transform(F.array(count), lambda n: F.transform(summed, lambda x: x / n)), 1)


def mean_pool(
    df: DataFrame, dim: int, group: str = "id", vector: str = "vec", mask: Column | str | None = None
) -> DataFrame:
    """Mean of the unmasked vectors of each group of a long token table.

    The state of a group is one vector buffer, combined on the map side: a group
    holding a third of all tokens still sends one row per task, and the plan has
    the same size for any ``dim``. A group whose mask is all zero keeps its row
    and pools to zeros. A missing vector counts as masked; a vector of another
    length than ``dim`` fails the job; a negative mask does so too.
    """
    mask = F.lit(1) if mask is None else (F.col(mask) if isinstance(mask, str) else mask)
    weight = F.when(F.col(vector).isNull(), F.lit(0.0)).otherwise(F.coalesce(mask.cast("double"), F.lit(0.0)))
    sized = of_length(F.col(vector), dim, F.col(vector)).cast("array<double>")
    rows = df.select(F.col(group), weight.alias("_mask"), sized.alias("_vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    masked = F.col("_mask") == 0
    # A masked row stands for zeros of the least weight, so that no group is without weight; the scale takes it out.
    rows = rows.select(
        group, "_mask", F.when(masked, MIN_TOKENS).otherwise(F.col("_mask")).alias("_weight"),
        array_to_vector(F.when(F.col("_vec").isNull() | masked, zeros).otherwise(F.col("_vec"))).alias("_vec"),
    )
    pooled = rows.groupBy(group).agg(
        F.sum("_mask").alias("_n"), F.sum("_weight").alias("_total"),
        Summarizer.metrics("mean").summary(F.col("_vec"), F.col("_weight")).alias("_s"),
    )
    scale = F.col("_total") / F.greatest("_n", F.lit(MIN_TOKENS))
    means = pooled.select(group, scale.alias("_scale"), vector_to_array("_s.mean").alias("_mean"))
    return means.select(group, F.transform("_mean", lambda x: x * F.col("_scale")).alias("pooled"))


def mean_vectors(lists: pa.ListArray, place: Callable[[str], int], matrix: np.ndarray) -> pa.ListArray:
    """Mean of the rows of ``matrix`` at the places of the words of each list; words of the last place do not count."""
    unknown = len(matrix) - 1
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    rows_of = np.array([place(w) for w in coded.dictionary.to_pylist()], int)
    at = rows_of[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, int)
    sums, known = np.zeros((len(lists), matrix.shape[1])), np.zeros(len(lists))
    step = max(1, PORTION // matrix.shape[1])
    for low in range(0, len(at), step):
        part = at[low : low + step]
        text_of = np.searchsorted(ends, np.arange(low, low + len(part)), "right")
        first = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
        sums[text_of[first]] += np.add.reduceat(matrix[part], first, axis=0)
        known[text_of[first]] += np.add.reduceat((part != unknown).astype("float64"), first)
    pooled = sums / np.maximum(known, MIN_TOKENS)[:, None]
    offsets = pa.array(np.arange(len(lists) + 1, dtype="int32") * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(pooled.ravel()))


def embed_text(
    df: DataFrame, token_vectors: DataFrame, dim: int, id_col: str = "id", text: str = "text", buckets: int = 0
) -> DataFrame:
    """Text -> mean of the vectors of its known words; zeros when none is known.

    ``token_vectors`` is ``(token, vector)``, at most :data:`MAX_NUMBERS` numbers,
    which are sent to each executor once. Words are cut in the JVM and pooled
    inside their row, on one buffer of ``dim`` sums: nothing is exploded, joined
    or shuffled, and rows of equal or missing id stay apart. (Built-in functions
    sum vectors inside a row by interpreted lambdas only, hence Arrow batches.)

    Vectors named by :func:`bucket` stand in for the words that have none.
    """
    held = token_vectors.count() * dim
    if held > MAX_NUMBERS:
        raise ValueError(f"token vectors hold {held} numbers, more than the {MAX_NUMBERS} that are sent to every executor")
    table = token_vectors.select("token", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    tokens, vectors = table.column("token").to_pylist(), table.column("vector").combine_chunks()
    if any(n != dim for n in vectors.value_lengths().to_pylist()):
        raise ValueError(f"expected token vectors of {dim} components")
    places = {token: i for i, token in enumerate(tokens)}
    matrix = np.concatenate((vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), np.zeros((1, dim))))
    sent = df.sparkSession.sparkContext.broadcast((places, matrix))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, matrix = sent.value
        unknown = len(matrix) - 1

        def place(word: str) -> int:
            at = word_place(places, word, buckets)
            return unknown if at is None else at

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), mean_vectors(batch.column(1), place, matrix)], names=[id_col, "pooled"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, words(text).alias("_words")).mapInArrow(pool, f"`{id_col}` {kind}, pooled array<double>")
