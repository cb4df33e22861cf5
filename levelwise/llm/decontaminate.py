"""Benchmark decontamination: a positional inverted index over the terms that can reveal benchmark text.

DataFrame functions only. A window is ``width`` consecutive words of an item (all words of a shorter item).

1. One pass counts every benchmark term over the whole corpus.
2. For each window the terms are ranked by that count. A second pass walks all training tokens and keeps the
   postings ``(document, position)`` of each window's rarest term, intersected at once with the offset-adjusted
   list of the second rarest: only positions where both stand at the right distance are stored, with the words
   around them.
3. Phrase matches compare the remaining terms at their offsets; proximity matches ask for all terms within a span.

The pass over the tokens is one generated stage: words are never materialised per token and text is not shuffled.
The benchmark side is broadcast while its counted rows stay within a bound. Beyond it a bitmap of the hashes of the
rarest terms, of bounded size, travels instead: one pass stages the tokens it lets through with the words around them,
and these few meet the windows in a sorted join. So any benchmark takes two passes over the corpus.

Defined results: null text, or text without words, has no words and no hits; an item without words is ignored;
items with equal text are both reported; a null id is a document of its own; identical rows of one id give one row;
rows of one id with different texts give one row each; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelwise.llm.common import BROADCAST_ROWS, ascii_lower, doc_key, from_doc_key, read, small_side, stage, text_key

WIDTH = 10
# Everything outside 0-9, a-z and non-ASCII separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word that no text holds: ends each document's token list and carries its length.
END = ""
END_ROW = (("window_id", "long", None), ("width", "int", 0), ("at", "int", 0), ("h2", "long", None), ("at2", "int", 0))
# Longs of the bitmap of a large benchmark's rarest terms: 16 million bits, 2 MB.
BITMAP_LONGS = 2**18


def words_of(text: str = "text") -> Column:
    parts = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN)
    return F.array_remove(parts, "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, terms`` for every window of every item that has words."""
    items = benchmark.select("item_id", words_of().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, width))).alias("terms"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``h, n``: corpus count of every benchmark term, zero included. Too many terms for a broadcast meet the counts
    of all words instead of the words."""
    tokens = docs.select(F.explode(words_of()).alias("w")).select(F.xxhash64("w").alias("h"))
    sought = tokens.join(F.broadcast(terms), "h") if n_terms <= limit else tokens
    counted = sought.groupBy("h").agg(F.count("*").alias("n"))
    return terms.join(counted, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))


def lookups(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per distinct window: its terms, and hash and offset of its rarest and second rarest term.

    A window of one word has itself as second term.
    """
    distinct = wins.select("terms").distinct().withColumn("window_id", F.xxhash64("terms"))
    placed = distinct.select("window_id", F.posexplode("terms").alias("at", "w")).withColumn("h", F.xxhash64("w"))
    order = F.array_sort(F.collect_list(F.struct("n", "at", "h")))
    ranked = placed.join(counts, "h").groupBy("window_id").agg(order.alias("by"))
    second = F.col("by")[F.when(F.size("by") > 1, 1).otherwise(0)]
    return distinct.join(ranked, "window_id").select(
        "window_id", "terms", F.size("terms").alias("width"),
        F.col("by")[0]["h"].alias("h"), F.col("by")[0]["at"].alias("at"),
        second["h"].alias("h2"), second["at"].alias("at2"),
    )


def bitmap(hashes: DataFrame, n: int, longs: int = BITMAP_LONGS) -> Callable[[Column], Column]:
    """A test that all ``h`` of ``hashes`` pass, and others by chance: one bit each among 16 a hash, ``longs`` * 64 at most."""
    size = min(max(n // 4, 1), longs)
    slot = lambda h: F.pmod(h, F.lit(size)).cast("int")
    bit = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))
    bits = [0] * size
    for row in hashes.groupBy(slot(F.col("h")).alias("slot")).agg(F.bit_or(one).alias("bits")).collect():
        bits[row["slot"]] = row["bits"]
    constant = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")
    return lambda h: F.getbit(F.get(constant, slot(h)), bit(h)) == 1


def postings(
    docs: DataFrame, wanted: DataFrame, n_wanted: int, reach: int = 0, limit: int = BROADCAST_ROWS, width: int = WIDTH
) -> DataFrame:
    """``_did, _tid, window_id, start, around`` where rarest and second rarest term stand at their distance.

    ``reach`` > 0 stores every posting of the rarest term with that many words on either side instead.
    Each document adds one row with ``window_id`` null and its number of words as ``start``.
    """
    tokens = docs.select(
        doc_key().alias("_did"), text_key().alias("_tid"), F.array_append(words_of(), END).alias("words")
    ).select("_did", "_tid", "words", F.posexplode("words").alias("pos", "w"))
    hashed, sought = tokens.withColumn("h", F.xxhash64("w")), wanted.drop("terms")
    near = F.greatest(F.col("pos") - (reach or width - 1), F.lit(0))
    if n_wanted <= limit:
        end = wanted.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("h"), *(F.lit(v).cast(t).alias(c) for c, t, v in END_ROW))
        found, low, size = hashed.join(F.broadcast(sought.unionByName(end)), "h"), F.lit(0), F.size("words")
    else:
        passes, is_end = bitmap(sought.select("h").distinct(), n_wanted), F.col("w") == END
        beside = F.slice("words", near + 1, F.col("pos") - near + (reach or width - 1) + 1)
        let_through = stage(hashed.filter(is_end | passes(F.col("h"))).select(
            "_did", "_tid", "h", "pos", F.size("words").alias("size"), is_end.alias("is_end"), F.when(~is_end, beside).alias("words")
        ), "tokens")
        ends = let_through.filter("is_end").select("*", *(F.lit(v).cast(t).alias(c) for c, t, v in END_ROW))
        found = let_through.filter("NOT is_end").join(sought.hint("merge"), "h").unionByName(ends)
        low, size = near, F.col("size")
    # ``words`` begins at position ``low`` of a text of ``size`` words, the end among them.
    start, is_end = F.col("pos") - F.col("at"), F.col("window_id").isNull()
    if reach:
        kept, around = F.lit(True), F.slice("words", near - low + 1, F.col("pos") - near + reach + 1)
    else:
        inside = (start >= 0) & (start + F.col("width") < size)
        kept = inside & (F.xxhash64(F.try_element_at("words", start - low + F.col("at2") + 1)) == F.col("h2"))
        around = F.slice("words", F.greatest(start - low, F.lit(0)) + 1, F.col("width"))
    return found.filter(is_end | kept).select(
        "_did", "_tid", "window_id", F.when(is_end, F.col("pos")).otherwise(start).alias("start"),
        F.when(~is_end, around).alias("around"),
    )


class PositionalIndex:
    """Stored postings of one corpus for one benchmark, for phrase and proximity queries."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, reach: int = 0, limit: int = BROADCAST_ROWS):
        self.windows = stage(windows(benchmark, width), "windows")
        terms = stage(self.windows.select(F.explode("terms").alias("w")).select(F.xxhash64("w").alias("h")).distinct(), "terms")
        counts = stage(term_counts(docs, terms, terms.count(), limit), "term-counts")
        self.lookups = stage(lookups(self.windows, counts), "lookups")
        self.n_lookups = self.lookups.count()
        self.reach, self.limit = reach, limit
        self.postings = stage(postings(docs, self.lookups, self.n_lookups, reach, limit, width), "postings")

    def lengths(self) -> DataFrame:
        """``_did, _tid, n_words`` of every document."""
        ends = self.postings.filter("window_id IS NULL")
        return ends.groupBy("_did", "_tid").agg(F.max("start").cast("long").alias("n_words"))

    def _with_terms(self) -> DataFrame:
        terms = small_side(self.lookups.select("window_id", "terms", "width"), self.n_lookups, self.limit)
        return self.postings.filter("window_id IS NOT NULL").join(terms, "window_id")

    def phrases(self) -> DataFrame:
        """``_did, _tid, window_id, start, width``: exact occurrences of whole windows."""
        if self.reach:
            raise ValueError("phrases need an index built with reach=0")
        return self._with_terms().filter(F.col("around") == F.col("terms")).select("_did", "_tid", "window_id", "start", "width")

    def near(self) -> DataFrame:
        """``_did, _tid, window_id``: documents with all terms of a window within ``reach`` words of its rarest term."""
        if not self.reach:
            raise ValueError("proximity needs an index built with reach > 0")
        missing = F.size(F.array_except("terms", "around"))
        return self._with_terms().filter(missing == 0).select("_did", "_tid", "window_id").distinct()

    def items(self, matches: DataFrame) -> DataFrame:
        """``_did, _tid, item_id`` of matches with a ``window_id``."""
        owners = self.windows.select(F.xxhash64("terms").alias("window_id"), "item_id").distinct()
        return matches.select("_did", "_tid", "window_id").distinct().join(owners, "window_id").select("_did", "_tid", "item_id")


def covered_words() -> Column:
    """Number of positions in the union of the sorted intervals ``spans``."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["start"] + span["width"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], F.least(span["start"], end))).alias("n"))

    return F.aggregate("spans", empty, add, lambda x: x["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``_did, _tid, n_words, n_hit, item_ids`` per document."""
    index = PositionalIndex(docs, benchmark, width, limit=limit)
    matches = index.phrases()
    hits = matches.groupBy("_did", "_tid").agg(F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"))
    items = index.items(matches).groupBy("_did", "_tid").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    return (
        index.lengths().join(hits, ["_did", "_tid"], "left").join(items, ["_did", "_tid"], "left")
        .select("_did", "_tid", "n_words", F.coalesce(covered_words(), F.lit(0)).alias("n_hit"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` without any word hit."""
    hit = contamination(docs, benchmark, width).filter("n_hit > 0").select("_did", "_tid")
    keyed = docs.select(F.struct("*").alias("row"), doc_key().alias("_did"), text_key().alias("_tid"))
    return keyed.join(hit, ["_did", "_tid"], "left_anti").select("row.*")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        from_doc_key("_did").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, list_slice(w, s + 1, s + 10) AS terms FROM (
    SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
heads AS (SELECT DISTINCT terms[1] AS head, len(terms) AS width FROM item_windows),
starts AS (
  SELECT d.doc_id, d.w, d.s, h.width FROM (
    SELECT doc_id, w, unnest(range(len(w))) AS s FROM doc_words) d JOIN heads h ON d.w[d.s + 1] = h.head
  WHERE d.s + h.width <= len(d.w)),
matches AS (
  SELECT m.doc_id, m.s, m.width, i.item_id FROM starts m
  JOIN item_windows i ON list_slice(m.w, m.s + 1, m.s + m.width) = i.terms),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(s, s + width)) AS p FROM matches) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM matches) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
