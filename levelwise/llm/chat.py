"""Chat formatting: cumulative snapshots of one conversation collapse into the longest, which is then rendered.

A logged conversation that is a prefix of a longer one is a snapshot of it; of equal conversations the smallest id
stays. What is left is rendered with a header per turn.

Turn order is (turn, role, text), nulls first. Equal rows of a conversation become one row with a count; these are
dealt into ranges of (conversation, turn, role, text), numbered inside their range, and counted starts of the ranges
give exact positions. So neither one conversation nor equal, null or repeated turn numbers bring rows into one task.

The hash of a prefix is the XOR of 128-bit hashes of (position, role, text), so it is a running aggregate, in two
levels: blocks of ``BLOCK`` positions and rows inside a block. Full hashes are a plain aggregate; snapshots are found
by an anti join of (length, full hash) with the prefix hashes of longer conversations, reduced to their distinct values
first. Text joins only the starts of its own range; ids, positions and hashes do the rest. A rendered segment holds the
turns of one block, and its number is that of the block, so no conversation has to fit into one row or task. A block of
more than ``SEGMENT_BYTES`` becomes several rows of that number, read in order of ``first_turn``.

Defined results: null role is rendered as ``unknown`` and null text as empty, but neither equals the other when
compared; a null conversation id is one conversation with the smallest id; a null turn number comes first; repeated
rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelwise.llm.common import read, small_side, stage

BLOCK = 256
# Rendered bytes of a block beyond which it becomes several rows.
SEGMENT_BYTES = 2**26
NO_ID = -(2**63)


RUNS = "conv long, part int, at long, n long, role string, text string, bytes long"


def runs(turns: DataFrame) -> DataFrame:
    """``RUNS``: different rows in turn order; ``at`` counts the turns of the conversation before it in its range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before = None, 0
        for batch in batches:
            own, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "n"))
            if not len(own):
                continue
            ends = np.cumsum(n)
            head = np.searchsorted(own, own, "left")  # first row of the same conversation
            at = ends - n - (ends - n)[head] + np.where(own == conv, before, 0)
            conv, before = own[-1], at[-1] + n[-1]
            yield pa.record_batch([batch.column("conv"), batch.column("part"), pa.array(at), *(batch.column(c) for c in ("n", "role", "text", "bytes"))], names=["conv", "part", "at", "n", "role", "text", "bytes"])

    order = ["conv", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    keyed = turns.select(F.coalesce("conv_id", F.lit(NO_ID)).cast("long").alias("conv"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    counted = keyed.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    # A range of its own number, since the default lets Spark join ranges.
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    size = F.octet_length(rendered_turn()).cast("long").alias("bytes")
    return stage(ranged.select("conv", F.spark_partition_id().alias("part"), "n", "role", "text", size).mapInArrow(number, RUNS), "runs")


def starts(numbered: DataFrame) -> DataFrame:
    """``conv, part, start``: position of a conversation's first turn in each of its ranges."""
    sizes = numbered.groupBy("conv", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))


def in_blocks(numbered: DataFrame, begun: DataFrame, block: int, *columns: Column | str) -> DataFrame:
    """``conv, block, pos, n`` and ``columns``: every run cut at the ends of blocks of positions."""
    first = F.col("start") + F.col("at")
    placed = numbered.join(begun, ["conv", "part"]).select("conv", first.alias("first"), (first + F.col("n")).alias("beyond"), *columns)
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("beyond") - 1) / block))
    names = [c for c in placed.columns if c not in ("conv", "first", "beyond")]
    cut = placed.select("conv", F.explode(blocks).alias("block"), "first", "beyond", *names)
    pos = F.greatest("first", F.col("block") * block)
    return cut.select("conv", "block", pos.alias("pos"), (F.least("beyond", (F.col("block") + 1) * block) - pos).alias("n"), *names)


def prefix_hashes(numbered: DataFrame, begun: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, n, p1, p2``: hash of the first ``n`` turns, for every turn."""
    content = [F.xxhash64(F.lit(i), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"h{i}") for i in (1, 2)]
    texts = numbered.select("conv", "part", "at", "n", *content)
    placed = in_blocks(texts, begun, block, "h1", "h2")
    placed = placed.select("conv", "block", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos"), "h1", "h2")
    hashed = placed.select("conv", "block", "pos", *(F.xxhash64(F.lit(i), "pos", f"h{i}").alias(f"t{i}") for i in (1, 2)))
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = sums.select("conv", "block", *(F.coalesce(F.bit_xor(f"s{i}").over(earlier), zero).alias(f"c{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hashed.select("conv", "block", "pos", *(F.bit_xor(f"t{i}").over(upto).alias(f"r{i}") for i in (1, 2)))
    return running.join(carried, ["conv", "block"]).select(
        "conv", (F.col("pos") + 1).alias("n"), F.col("r1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("p2")
    )


def maximal_conversations(numbered: DataFrame, begun: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv`` of conversations that are no prefix of a longer one, the smallest id of equal ones."""
    prefixes = stage(prefix_hashes(numbered, begun, block), "prefixes")
    lengths = prefixes.groupBy("conv").agg(F.max("n").alias("length"))
    tagged = prefixes.join(lengths, "conv")
    key = ["n", "p1", "p2"]
    full = tagged.filter(F.col("n") == F.col("length")).groupBy(*key).agg(F.min("conv").alias("conv"))
    # Proper prefixes, each once however many conversations begin with it.
    proper = tagged.filter(F.col("n") < F.col("length")).select(*key).distinct()
    return full.join(proper, key, "left_anti").select("conv")


def rendered_turn() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))


def render(placed: DataFrame) -> DataFrame:
    """``conv, segment, first_turn, n_turns, rendered`` of turns ``conv, block, cut, pos, n, role, text``."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "n", rendered_turn().alias("part"))))
    segments = placed.groupBy("conv", "block", "cut").agg(F.sum("n").alias("n_turns"), parts.alias("parts"))
    return segments.select(
        "conv", F.col("block").alias("segment"), F.col("parts")[0]["pos"].alias("first_turn"), "n_turns",
        F.array_join(F.transform("parts", lambda p: F.repeat(p["part"], p["n"].cast("int"))), "").alias("rendered"),
    )


def cut_by_bytes(placed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``placed`` with ``cut``: 0, or the place among the parts of a block of more than ``most`` bytes.

    ``sizes`` (``conv, block, pos, n, bytes``) has the same turns without their text. A part ends with the turn that
    brings it to ``most`` bytes, so it holds fewer than that and one turn.
    """
    total = sizes.groupBy("conv", "block").agg(F.sum(F.col("n") * F.col("bytes")).alias("total"))
    long = stage(total.filter(F.col("total") > most).select("conv", "block"), "long-blocks")
    n_long = long.count()
    if not n_long:
        return placed.withColumn("cut", F.lit(0).cast("long"))
    long = small_side(long, n_long)
    each = F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")
    turns = sizes.join(long, ["conv", "block"], "left_semi").select("conv", "block", "bytes", each)
    earlier = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cuts = turns.select("conv", "block", "pos", F.floor(F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) / most).alias("cut"))
    split = placed.join(long, ["conv", "block"], "left_semi").select("conv", "block", each, F.lit(1).cast("long").alias("n"), "role", "text")
    whole = placed.join(long, ["conv", "block"], "left_anti").withColumn("cut", F.lit(0).cast("long"))
    return whole.unionByName(split.join(cuts, ["conv", "block", "pos"]))


def format_chats(turns: DataFrame, block: int = BLOCK, most: int = SEGMENT_BYTES) -> DataFrame:
    """``conv_id, segment, first_turn, n_turns, rendered`` of the maximal conversations."""
    numbered = runs(turns)
    begun = stage(starts(numbered), "starts")
    kept = stage(begun.join(maximal_conversations(numbered, begun, block), "conv", "left_semi"), "kept")
    sizes = in_blocks(numbered, kept, block, "bytes")
    chosen = render(cut_by_bytes(in_blocks(numbered, kept, block, "role", "text"), sizes, most))
    return chosen.select(F.nullif(F.col("conv"), F.lit(NO_ID)).alias("conv_id"), "segment", "first_turn", "n_turns", "rendered")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


# One segment per conversation: no conversation of the tables has more than BLOCK turns.
SQL = f"""
WITH placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS pos,
         '<' || coalesce(role, chr(0)) || '>' || coalesce(text, chr(0)) || chr(1) AS cell
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
prefixes AS (
  SELECT conv_id, pos + 1 AS n, string_agg(cell, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed),
lengths AS (SELECT conv_id, count(*) AS length FROM placed GROUP BY conv_id),
whole AS (
  SELECT min(p.conv_id) AS conv_id, p.n, p.prefix FROM prefixes p JOIN lengths l ON p.conv_id = l.conv_id AND p.n = l.length
  GROUP BY p.n, p.prefix),
proper AS (
  SELECT DISTINCT p.n, p.prefix FROM prefixes p JOIN lengths l ON p.conv_id = l.conv_id AND p.n < l.length),
kept AS (SELECT w.conv_id FROM whole w ANTI JOIN proper p ON w.n = p.n AND w.prefix = p.prefix),
blocks AS (
  SELECT conv_id, turn // {BLOCK} AS block, min(pos) AS first_turn, count(*) AS n_turns,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM placed WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, turn // {BLOCK})
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS segment, first_turn, n_turns, rendered FROM blocks
"""
