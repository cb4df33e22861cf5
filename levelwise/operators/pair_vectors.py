"""Word vectors by skip-gram on exact counts of word pairs.

1. Each task counts the pairs of words at most :data:`WINDOW` places apart in a text. A pair weighs ``WINDOW + 1``
   less its distance: ``WINDOW`` times what the random windows of Word2Vec give it on average. Weights are integers,
   so the sums are the same however the texts are cut into tasks.
2. Spark adds the counts per pair. There are at most as many pairs as the square of the words, whatever the corpus.
3. Skip-gram is trained on the counts alone, with the softmax over all words: tasks sum the gradient over their share
   of the pairs, the driver takes an Adagrad step. It holds two vectors per word, never pairs.

The text is read once; the passes of the training cost what the pairs cost, not what the words cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.sources.staging import stage

# Places between two words of a pair, at most; with the weights, less than 8.
WINDOW = 5
# Words whose pairs are sorted at a time, and different pairs that a task holds.
PORTION, HELD = 1 << 20, 1 << 22
# Pairs of a part of the staged table, and logits held at a time in a task.
PART_PAIRS, CELLS = 1_000_000, 1 << 21
# Steps of the training, their size, and what keeps the first of them finite.
PASSES, RATE, LEAST = 20, 0.2, 1e-12

Counts = tuple[np.ndarray, np.ndarray]


def added(keys: np.ndarray, n: np.ndarray) -> Counts:
    """Counts added per key; keys are sorted."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def merged(held: list[Counts]) -> Counts:
    keys, n = (np.concatenate(arrays) for arrays in zip(*held))
    order = np.argsort(keys, kind="stable")
    return added(keys[order], n[order])


def portion_counts(at: np.ndarray, text_of: np.ndarray, low: int, size: int) -> Counts:
    """Keys and weights of the words in the portion from ``low`` and of the pairs that start there.

    The pair of words i <= j has the key ``i * size + j``, the word i itself ``-1 - i``.
    """
    high = min(low + PORTION, len(at))
    # The weight rides in the lowest three bits, so that one sort does.
    packed = [(-1 - at[low:high]) << 3 | 1]
    for distance in range(1, WINDOW + 1):
        second = at[low + distance : high + distance]
        first = at[low : low + len(second)]
        same = text_of[low : low + len(second)] == text_of[low + distance : high + distance]
        keys = np.minimum(first, second)[same] * size + np.maximum(first, second)[same]
        packed.append(keys << 3 | (WINDOW + 1 - distance))
    whole = np.sort(np.concatenate(packed))
    return added(whole >> 3, whole & 7)


def pair_counts(texts: DataFrame, column: str, size: int, code: Callable[[str], int]) -> DataFrame:
    """``key, n`` of every word and every pair of near words of the texts, as :func:`portion_counts` names them.

    ``code`` gives a word its number below ``size``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []

        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in batches:
            lists = batch.column(0)
            coded = lists.flatten().dictionary_encode()
            numbers = np.array([code(word) for word in coded.dictionary.to_pylist()], "int64")
            at = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, "int64")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            text_of = np.repeat(np.arange(len(lengths)), lengths)
            for low in range(0, len(at), PORTION):
                held.append(portion_counts(at, text_of, low, size))
                if sum(len(keys) for keys, _ in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged(held))

    return texts.select(column).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def directed_pairs(counts: DataFrame, size: int) -> DataFrame:
    """``i, j, n`` for both directions of every pair."""
    pairs = counts.where("key >= 0").select(F.expr(f"int(key div {size})").alias("i"), F.expr(f"int(key % {size})").alias("j"), "n")
    alike = F.col("i") == F.col("j")
    both = pairs.withColumn("n", F.when(alike, F.col("n") * 2).otherwise(F.col("n")))
    return both.union(pairs.where(~alike).select("j", "i", "n"))


def blocks(pairs: DataFrame, partitions: int) -> DataFrame:
    """The pairs by word, an Arrow batch of them to a row: every pass reads them as they lie in memory."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
                yield pa.record_batch([pa.array([array.tobytes()], pa.binary()) for array in arrays], names=["i", "j", "n"])

    dealt = pairs.repartition(partitions, "i").sortWithinPartitions("i")
    return stage(dealt.mapInArrow(pack, "i binary, j binary, n binary"), "word-pairs")


def block_gradient(starts: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, words: np.ndarray, near: np.ndarray) -> Counts:
    """Gradient of the log likelihood of rows that start anew with a word at ``starts``: by their words, by all near words."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(i)]))
    own = words[i[starts]]
    shares = own @ near.T
    shares -= shares.max(1, keepdims=True)
    np.exp(shares, out=shares)
    # Counts less what the model expects of as many.
    shares *= (-np.add.reduceat(n, starts) / shares.sum(1))[:, None]
    shares[of, j] += n
    return shares @ near, shares.T @ own


def gradients(packed: DataFrame, words: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient by both sets of vectors, summed over all pairs by Spark."""
    sent = packed.sparkSession.sparkContext.broadcast((words, near))
    cells = CELLS

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, near = sent.value
        sums = np.zeros((2, *words.shape))
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                i, j, n = (np.frombuffer(packed, kind) for packed, kind in zip(row, ("int32", "int32", "int64")))
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                step = max(1, cells // len(words))
                for low in range(0, len(starts), step):
                    first = starts[low]
                    last = starts[low + step] if low + step < len(starts) else len(i)
                    own, part = starts[low : low + step] - first, slice(first, last)
                    by_word, by_near = block_gradient(own, i[part], j[part], n[part].astype("float64"), words, near)
                    np.add.at(sums[0], i[part][own], by_word)
                    sums[1] += by_near
        for side in (0, 1):
            used = np.flatnonzero(sums[side].any(1))
            ends = pa.array(np.arange(len(used) + 1, dtype="int32") * words.shape[1])
            own = pa.ListArray.from_arrays(ends, pa.array(sums[side][used].ravel()))
            yield pa.record_batch([pa.array(np.full(len(used), side, "int32")), pa.array(used.astype("int32")), own], names=["side", "at", "g"])

    partial = packed.mapInArrow(ascend, "side int, at int, g array<double>")
    summed = partial.groupBy("side", "at").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    table = summed.select("side", "at", vector_to_array("g").alias("g")).toArrow()
    out = np.zeros((2, *words.shape))
    if table.num_rows:
        flat = table.column("g").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[table.column("side").to_numpy(), table.column("at").to_numpy()] = flat.reshape(-1, words.shape[1])
    sent.unpersist()
    return out[0], out[1]


def train_pairs(packed: DataFrame, weights: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors of the words after :data:`PASSES` steps over all pairs. A word without pairs keeps the vector it starts with."""
    size = len(weights)
    words, near = (np.random.default_rng(seed).random((size, dim)) - 0.5) / dim, np.zeros((size, dim))
    squares = np.zeros((2, size, dim))
    scale = 1.0 / np.maximum(weights, 1.0)[:, None]
    for _ in range(PASSES):
        steps = [g * scale for g in gradients(packed, words, near)]
        for side, (vectors, g) in enumerate(zip((words, near), steps)):
            squares[side] += g * g
            vectors += RATE * g / np.sqrt(squares[side] + LEAST)
    return words


def learn_vectors(
    texts: DataFrame, column: str, size: int, dim: int, code: Callable[[str], int], seed: int, partitions: int | None = None
) -> tuple[Sequence[int], np.ndarray]:
    """Numbers of the words that occur, and a vector for each number below ``size``.

    Every word of every text counts. ``partitions`` cuts the table of pairs, by default one part per
    :data:`PART_PAIRS` of them.
    """
    counts = stage(pair_counts(texts, column, size, code), "pair-counts")
    found = sorted(-1 - row["key"] for row in counts.where("key < 0").select("key").collect())
    pairs = directed_pairs(counts, size)
    weights = np.zeros(size)
    for row in pairs.groupBy("i").agg(F.sum("n").alias("n")).collect():
        weights[row["i"]] = row["n"]
    packed = blocks(pairs, partitions or max(1, -(-2 * counts.count() // PART_PAIRS)))
    return found, train_pairs(packed, weights, dim, seed)
