"""Corpus encoding: learn a vocabulary, then turn text into padded id arrays."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from levelwise.functions.text import words
from levelwise.sources.staging import stage

# Special token ids and default length.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
SPECIAL_IDS = 4
MAX_LENGTH = 128

# Largest vocabulary that travels to the tasks as a constant; larger ones are joined.
MAX_VOCABULARY = 131_072


def learn_vocabulary(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``(token, token_id)`` of the most frequent words; ties go to the smaller word.

    Counts are combined before the shuffle, so a word that fills a third of the
    corpus is one row per task. The count of the last winner follows from the
    counts of counts; words that reach it are sorted by range and numbered within
    their range, so no task sees more than its share, however many are wanted.
    """
    if size < 1:
        raise ValueError(f"vocabulary size must be positive, got {size}")
    return ranked_words(stage(word_counts(df, text), "word-counts"), size)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` of every word."""
    return df.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def least_winner(counts: DataFrame, size: int) -> int:
    """Count of the last of the ``size`` most frequent words; 0 if there are none."""
    # One row per distinct count: about the square root of the corpus at most.
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tied"))
    above = F.sum("tied").over(Window.orderBy(F.desc("n"))) - F.col("tied")
    return by_count.withColumn("above", above).where(F.col("above") < size).agg(F.min("n")).first()[0] or 0


def ranked_words(counts: DataFrame, size: int) -> DataFrame:
    """``(token, token_id, n)`` of the most frequent words of a staged table of counts."""
    reached = counts.where(F.col("n") >= least_winner(counts, size)).orderBy(F.desc("n"), "token")
    ranges = stage(reached.withColumn("range", F.spark_partition_id()), "ranked-words")
    sizes = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}
    starts = [(r, sum(n for other, n in sizes.items() if other < r)) for r in sizes]
    before = counts.sparkSession.createDataFrame(starts, "range int, before long").coalesce(1)
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("n"), "token")) + F.col("before")
    numbered = ranges.join(F.broadcast(before), "range").withColumn("rank", rank).where(F.col("rank") <= size)
    return numbered.select("token", (F.col("rank") + (SPECIAL_IDS - 1)).cast("int").alias("token_id"), "n")


def encode_corpus(
    df: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "id",
    text: str = "text",
    max_length: int = MAX_LENGTH,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, input_ids, attention_mask`` with fixed-length arrays.

    Words are cut to the ``max_length - 2`` that fit, then looked up inside
    their row, so nothing is exploded, joined or shuffled. ``vocabulary`` comes
    from :func:`learn_vocabulary`; up to :data:`MAX_VOCABULARY` words it travels
    to the tasks as a constant, a larger one is joined by word.
    """
    if max_length < 3:
        raise ValueError("max_length must leave room for start, end and one word")
    first = F.slice(words(text), 1, max_length - 2)
    if vocabulary.limit(MAX_VOCABULARY + 1).count() <= MAX_VOCABULARY:
        rows = df.select(id_col, *keep, F.transform(first, lookup(vocabulary)).alias("body"))
    else:
        # Every row has a key of its own: ids may repeat or be missing.
        keyed = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(id_col, *keep).alias("_kept"), first.alias("_words"))
        tokens = keyed.select("_row", "_kept", F.posexplode_outer("_words").alias("pos", "token"))
        known = tokens.join(vocabulary.select("token", "token_id"), "token", "left")
        placed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("token_id")))))
        bodies = known.groupBy("_row").agg(F.first("_kept").alias("_kept"), F.transform(placed, lambda t: t["token_id"]).alias("body"))
        rows = bodies.select("_kept.*", "body")
    real = F.concat(F.array(F.lit(START)), F.coalesce("body", F.array().cast("array<int>")), F.array(F.lit(END)))
    with_ids = rows.select(id_col, *keep, real.alias("ids"))
    pads = F.lit(max_length) - F.size("ids")
    return with_ids.select(
        id_col,
        *keep,
        F.concat("ids", F.array_repeat(F.lit(PAD), pads)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), pads)).alias("attention_mask"),
    )


def lookup(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """A column function from word to id.

    A Spark map is searched from its start, so the words are spread by hash
    over as many small maps as there are words: a lookup then takes constant
    time.
    """
    entries = vocabulary.select("token", "token_id", F.hash("token").alias("hash")).collect()
    size = max(len(entries), 1)
    maps: list[dict[str, int]] = [{} for _ in range(size)]
    for entry in entries:
        maps[entry["hash"] % size][entry["token"]] = entry["token_id"]
    constant = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    def token_id(token: Column) -> Column:
        small = F.get(constant, F.pmod(F.hash(token), F.lit(size)))
        return F.coalesce(F.element_at(small, token), F.lit(UNKNOWN))

    return token_id


def real_tokens(mask: Column | str = "attention_mask") -> Column:
    """Number of unmasked positions."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.aggregate(mask, F.lit(0), lambda total, m: total + m)


def bucket(word: Column | str, buckets: int) -> Column:
    """Name of the bucket of a word outside a vocabulary, by a hash of the whole word; no word has such a name."""
    word = F.col(word) if isinstance(word, str) else word
    number = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets
    return F.concat(F.lit("#"), number.cast("string"))


def word_place(places: dict[str, int], word: str, buckets: int) -> int | None:
    """The place of a word, or else that of its :func:`bucket`; none if neither has one."""
    at = places.get(word)
    if at is None and buckets:
        at = places.get(f"#{int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % buckets}")
    return at
