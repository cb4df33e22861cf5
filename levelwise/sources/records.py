"""CSV with newlines inside quoted fields, read in splits.

A line break ends a record exactly if the number of quotes before it in its file is even (doubled quotes count as
two). So the quotes of each split are counted first; their running parity tells for every split whether it starts
inside a quoted field. With that each split cuts its own lines into records, in the order it reads them and without
moving any. A record that lies on a cut leaves a fragment on either side, and those few are joined by file and place.

Quotes must stand around whole fields, with quotes inside them doubled, as writers of this format do; a file with a
stray quote is cut at other places than its writer meant. Compressed files are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, THROUGH, TAIL = "whole", "head", "through", "tail"
RECORDS = "file string, block long, first boolean, part string, record string"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block, odd``: lines in the order of their split, and whether they hold an odd number of quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (quotes % 2 == 1).alias("odd"))


def open_splits(lines: DataFrame) -> DataFrame:
    """``file, block`` of the splits that start inside a quoted field: one row per split at most."""
    counted = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("long")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("file", "block", F.coalesce(before, F.lit(0)).alias("before")).where("before % 2 = 1").select("file", "block")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, first``: the text of every record; ``first`` marks the first one of each file."""
    lines = split_lines(spark, path)
    # The broadcast side has one row per split, so lines keep their order.
    opened = F.broadcast(open_splits(lines).withColumn("inside", F.lit(True)))
    placed = lines.join(opened, ["file", "block"], "left").select("value", "file", "block", "odd", F.coalesce("inside", F.lit(False)).alias("inside"))
    parts = placed.mapInArrow(cut_records, RECORDS)
    whole = parts.where(F.col("part") == WHOLE)
    # At most two fragments per split: one on either side of each cut.
    fragments = parts.where(F.col("part") != WHOLE)
    number = F.sum((F.col("part") == TAIL).cast("long")).over(Window.partitionBy("file").orderBy("block", F.col("part") == TAIL))
    joined = fragments.withColumn("number", number).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("part") == HEAD, "record", "first"))).alias("own"))
    stitched = joined.select(F.array_join(F.transform("own", lambda p: p["record"]), "\n").alias("record"), F.exists("own", lambda p: p["first"]).alias("first"))
    records = whole.select("record", "first").union(stitched)
    return records.select(F.regexp_replace("record", "\r\\z", "").alias("record"), "first")


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole splits, in order, into records and fragments; holds the lines of one open record."""
    split, inside, held, continues, at_start = None, False, [], False, False

    def row(part: str, text: str) -> tuple:
        return (*split, at_start, part, text)

    for batch in batches:
        out: list[tuple] = []
        values, files, blocks = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        odd, opened = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        for i in range(batch.num_rows):
            if split is None or blocks[i] != split[1] or files[i].as_py() != split[0]:
                if held:
                    out.append(row(THROUGH if continues else TAIL, "\n".join(held)))
                split, inside, held = (files[i].as_py(), int(blocks[i])), bool(opened[i]), []
                continues, at_start = inside, split[1] == 0
            inside ^= bool(odd[i])
            if inside:
                held.append(values[i].as_py())
                continue
            text = values[i].as_py()
            out.append(row(HEAD if continues else WHOLE, "\n".join([*held, text]) if held else text))
            held, continues, at_start = [], False, False
        yield record_rows(out)
    if held:
        yield record_rows([row(THROUGH if continues else TAIL, "\n".join(held))])


def record_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "first", "part", "record"])


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header each, as text; any number of splits per file.

    Every file must have the columns of the first one in the same order. Empty lines between records are left out.
    """
    # Reads the first record of one file.
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    records = csv_records(spark, path).where(~F.col("first") & (F.col("record") != ""))
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
