"""Line dedup: hashes range-partitioned with a secondary sort, first occurrences streamed, keep bitmaps returned.

DataFrame functions only. A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.
A key of at least ``min_chars`` code points that occurs in two or more documents keeps its lines in the smallest
document id that holds it and loses them everywhere else.

1. Lines become 128-bit key hashes. They are combined per hash and salt before any shuffle, so that a line that a
   third of all documents share is a handful of rows.
2. The combined rows are range-partitioned by hash and sorted by hash, document and position; a window streams over
   them and leaves each shared hash with the document of its first occurrence.
3. Lines join the shared hashes (a sort-merge join whose hot keys Spark splits). The positions to drop become one
   run-length coded bitmap per document; text is touched again only by ``apply_keep``.

Defined results: null or empty text is one empty line; a null id is a document of its own after all others;
identical rows of one id count as one document, rows of one id with different texts too (their lines all count for
that id, each row has its own bitmap); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelwise.llm.common import ascii_lower, doc_key, read, text_key

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
SALTS = 8


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def key_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``_did, _tid, pos, h1, h2`` for every line long enough to be compared."""
    lines = docs.select(doc_key().alias("_did"), text_key().alias("_tid"), F.posexplode(lines_of()).alias("pos", "line"))
    # Cheap test first: code points never outnumber bytes.
    trimmed = lines.filter(F.octet_length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(SPACE)))
    keys = trimmed.filter(F.char_length("line") >= min_chars).withColumn("line", ascii_lower("line"))
    return keys.select("_did", "_tid", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def shared_lines(hashes: DataFrame, salts: int = SALTS) -> DataFrame:
    """``h1, h2, keeper``: hashes found in two documents or more, and the smallest document."""
    combined = hashes.groupBy("h1", "h2", F.pmod("_did", F.lit(salts)).alias("salt")).agg(
        F.min(F.struct("_did", "pos")).alias("first"), F.max("_did").alias("last")
    )
    ordered = combined.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    group = Window.partitionBy("h1", "h2").orderBy("first")
    streamed = ordered.select(
        "h1", "h2", F.row_number().over(group).alias("nth"), F.col("first._did").alias("keeper"),
        F.max("last").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
    )
    return streamed.filter((F.col("nth") == 1) & (F.col("keeper") != F.col("last"))).select("h1", "h2", "keeper")


def drop_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Compressed bitmaps: ``_did, _tid, n_dropped, runs``; ``runs`` lists (first, end) of dropped lines, end excluded.

    Documents that keep every line have no row.
    """
    hashes = key_hashes(docs, min_chars)
    dropped = (
        hashes.join(shared_lines(hashes), ["h1", "h2"])
        .filter(F.col("_did") != F.col("keeper"))
        .groupBy("_did", "_tid")
        .agg(F.array_sort(F.collect_set("pos")).alias("at"))
    )
    first = F.filter("at", lambda p, i: (i == 0) | (F.col("at")[F.greatest(i - 1, F.lit(0))] != p - 1))
    final = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.col("at")[F.least(i + 1, F.size("at") - 1)] != p + 1))
    runs = F.zip_with(first, final, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("end")))
    return dropped.select("_did", "_tid", F.size("at").alias("n_dropped"), runs.alias("runs"))


def apply_keep(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``row, n_lines, n_dropped, kept``: every row of ``docs`` as a struct, and its text without the dropped lines."""
    keyed = docs.select(F.struct("*").alias("row"), doc_key().alias("_did"), text_key().alias("_tid"))
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    ends = F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("lines")))
    slices = F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a))
    whole = F.coalesce("row.text", F.lit(""))
    # Lines are split after the join: the text travels once.
    return keyed.join(runs, ["_did", "_tid"], "left").withColumn("lines", lines_of("row.text")).select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), whole).otherwise(F.array_join(F.flatten(slices), "\n")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row, n_lines, n_dropped, kept`` per row of ``docs``."""
    return apply_keep(docs, drop_runs(docs.select("doc_id", "text"), min_chars))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_chars``, if there is such a column, counted anew."""
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return dedup_lines(docs, min_chars).select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return result.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
