"""The most frequent words by mergeable summaries: bounded counters per task, then an exact count of the candidates.

1. Each task keeps at most ``counters`` words with counts. When there are more, the count of the first word beyond
   them is taken from all, and words without a count left go; the sum of what was taken is the task's loss.
2. Summaries merge by adding counts per word and losses in all. A word's true count lies between its merged count and
   that plus the loss, so every word that may be among the first ``size`` is known from the merged counts.
3. A second pass counts those candidates alone. Without any loss the merged counts are exact and it is left out.

A summary that cannot tell candidates from the rest (the loss is half of the least winning count or more) is taken
again with four times the counters; beyond ``MAX_COUNTERS`` all words are counted. The result is the same each way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.functions.text import words
from levelwise.operators.encode import MAX_VOCABULARY, learn_vocabulary, least_winner, ranked_words, word_counts
from levelwise.sources.staging import stage

# Counters per wanted word, and most counters of a task.
PER_WORD = 8
MAX_COUNTERS = 2**20

SUMMARY = "token string, n long"


def combined(tables: list[pa.Table]) -> pa.Table:
    """Counts added per word."""
    added = pa.concat_tables(tables).group_by("token").aggregate([("n", "sum")])
    return pa.table({"token": added["token"], "n": added["n_sum"]})


def reduced(table: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """At most ``counters`` words, and what was taken from each count."""
    if table.num_rows <= counters:
        return table, 0
    order = pc.select_k_unstable(table, counters + 1, [("n", "descending")])
    taken = table["n"].take(order)[counters].as_py()
    left = table.filter(pc.greater(table["n"], taken))
    return pa.table({"token": left["token"], "n": pc.subtract(left["n"], taken)}), taken


def summaries(df: DataFrame, counters: int, text: str = "text") -> DataFrame:
    """``token, n`` per task; the row without a token holds the task's loss."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows = loss = 0
        for batch in batches:
            counts = pc.value_counts(batch.column("words").flatten())
            kept.append(pa.table({"token": counts.field("values").cast(pa.string()), "n": counts.field("counts")}))
            rows += len(counts)
            if rows > 2 * counters:
                table, taken = reduced(combined(kept), counters)
                kept, rows, loss = [table], table.num_rows, loss + taken
        if kept:
            table, taken = reduced(combined(kept), counters)
            yield from table.to_batches()
            yield pa.record_batch([pa.array([None], pa.string()), pa.array([loss + taken], pa.int64())], names=["token", "n"])

    return df.select(words(text).alias("words")).mapInArrow(summarise, SUMMARY)


def heavy_words(df: DataFrame, size: int, text: str = "text", counters: int | None = None) -> DataFrame:
    """``token, token_id, n`` as :func:`learn_vocabulary` gives it; ties go to the smaller word.

    Null and empty texts have no words. Staged rows are at most ``counters`` per task, whatever the number of words.
    """
    if size < 1:
        raise ValueError(f"vocabulary size must be positive, got {size}")
    counters = PER_WORD * size if counters is None else counters
    if counters < 1:
        raise ValueError(f"counters must be positive, got {counters}")
    while counters <= MAX_COUNTERS:
        found = stage(summaries(df, counters, text), "word-summaries")
        loss = found.where(F.col("token").isNull()).agg(F.sum("n")).first()[0] or 0
        merged = found.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))
        if not loss:
            return ranked_words(stage(merged, "word-counts"), size)
        least = least_winner(merged, size)
        if least > 2 * loss:
            candidates = stage(merged.where(F.col("n") + loss >= least).select("token"), "candidate-words")
            return ranked_words(stage(counted(df, candidates, text), "word-counts"), size)
        counters *= 4
    return learn_vocabulary(df, size, text)


def counted(df: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` of the candidates; too many for a broadcast meet counts instead of words."""
    if candidates.count() > MAX_VOCABULARY:
        return word_counts(df, text).join(candidates.hint("merge"), "token", "left_semi")
    tokens = df.select(F.explode(words(text)).alias("token"))
    return tokens.join(F.broadcast(candidates), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
