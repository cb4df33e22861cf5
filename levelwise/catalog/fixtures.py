"""Views derived from the given tables, for Spark and as SQL text.

The tables carry no proficiency labels, so six ordered, imbalanced levels are
cut from text length. They exercise the operators; they measure no language
skill. Every row of a table is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, id_to_label
from levelwise.functions.text import words

# Lower length edges of levels 1..5.
LENGTH_EDGES = (400, 1000, 2000, 4000, 8000)

DIM = 64
# The words of a text in SQL: letters, marks and digits of every script.
WORDS_SQL = r"regexp_extract_all(lower({text}), '[\pL\pM\pN]+')"
# Candidates of the selection queries: assumed characters per word.
CANDIDATES = (3, 4, 5, 6, 7, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")


def length_level(chars: Column) -> Column:
    return sum(((chars >= edge).cast("int") for edge in LENGTH_EDGES[1:]), (chars >= LENGTH_EDGES[0]).cast("int"))


def level_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, n_chars, y``"""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "n_chars", length_level(F.col("n_chars")).alias("y"))


def level_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, y, p, confidence``: predictions that miss by one level at a known rate."""
    up, down = F.least(F.col("y") + 1, F.lit(5)), F.greatest(F.col("y") - 1, F.lit(0))
    p = F.when(F.col("id") % 5 == 0, up).when(F.col("id") % 7 == 0, down).otherwise(F.col("y"))
    return level_docs(spark, sf_dir).select(
        "id", "text", "y", p.alias("p"), (((F.col("id") * 37) % 101).cast("double") / 100.0).alias("confidence")
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, label, label_id``"""
    return level_docs(spark, sf_dir).select(
        "id", "text", id_to_label("y").alias("label"), F.col("y").alias("label_id")
    )


def head_weight(k: int, i: int) -> float:
    return float((k * 31 + i * 17) % 13 - 6) / 6.0


def fixed_head(dim: int) -> list[list[float]]:
    return [[head_weight(k, i) for i in range(dim)] for k in range(len(LEVELS))]


def sentence_bias() -> list[float]:
    """Small irrational offsets: no two classes tie on rational features."""
    return [math.sqrt(k + 1) / 1000.0 for k in range(len(LEVELS))]


def sentence_features(sentence: str = "sentence") -> Column:
    """Four plain measures of a sentence."""
    vowels = F.length(F.regexp_replace(sentence, "[^aeiou]", ""))
    commas = F.length(F.regexp_replace(sentence, "[^,]", ""))
    return F.array(
        F.length(sentence) / F.lit(100.0),
        F.size(words(sentence)) / F.lit(10.0),
        vowels / F.lit(50.0),
        commas.cast("double"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, sentences``: each document's text cut at full stops and line ends."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), F.split("text", "[.\n]").alias("sentences")
    )


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of a request log.

    Spanish documents come without sentences and German ones as a line that is no JSON.
    """
    sentences = F.when(F.col("lang") != "es", F.split("text", "[.\n]")).otherwise(F.array().cast("array<string>"))
    payload = F.to_json(F.struct(F.col("doc_id").alias("request_id"), sentences.alias("sentences")))
    cut = F.concat(F.lit("{"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "de", cut).otherwise(payload).alias("value"))


def residue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each line without ASCII letters: often blank, sometimes nothing."""
    residue = F.split(F.regexp_replace("text", "[A-Za-z.,]", ""), "\n")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), F.filter(residue, lambda s: s != "").alias("sentences")
    )


DOCS_SQL = f"""level_docs AS (
  SELECT doc_id AS id, text, n_chars,
         {' + '.join(f'CAST(n_chars >= {edge} AS INT)' for edge in LENGTH_EDGES)} AS y
  FROM documents)"""

PRED_SQL = f"""{DOCS_SQL}, level_pred AS (
  SELECT id, text, y,
         CASE WHEN id % 5 = 0 THEN LEAST(y + 1, 5) WHEN id % 7 = 0 THEN GREATEST(y - 1, 0) ELSE y END AS p,
         CAST((id * 37) % 101 AS DOUBLE) / 100.0::DOUBLE AS confidence
  FROM level_docs)"""

LEVELS_SQL = "levels(label_id, code) AS (VALUES " + ", ".join(
    f"({i}, '{level}')" for i, level in enumerate(LEVELS)
) + ")"

CELLS_SQL = f"""{PRED_SQL}, {LEVELS_SQL}, cells AS (
  SELECT y, p, count(*) AS n FROM level_pred GROUP BY y, p)"""

STATS_SQL = f"""{CELLS_SQL}, stats AS (
  SELECT l.label_id, l.code,
         COALESCE((SELECT sum(n) FROM cells WHERE y = l.label_id AND p = l.label_id), 0)::BIGINT AS tp,
         COALESCE((SELECT sum(n) FROM cells WHERE y = l.label_id), 0)::BIGINT AS support,
         COALESCE((SELECT sum(n) FROM cells WHERE p = l.label_id), 0)::BIGINT AS predicted
  FROM levels l), perf AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS prec,
         CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS rec,
         CASE WHEN support + predicted = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (support + predicted) END AS f1
  FROM stats)"""

REQUESTS_SQL = """requests AS (
  SELECT doc_id AS request_id, string_split_regex(text, '[.\n]') AS sentences FROM documents),
exploded AS (
  SELECT request_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS pos FROM requests)"""

ASCII_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def head_sql(source: str, key: str, vector: str, dim: int, bias: str = "0") -> str:
    """Logit of every class for every row of ``source``: ``key, k, logit``."""
    terms = "(CAST((k * 31 + i * 17) % 13 - 6 AS DOUBLE) / 6.0::DOUBLE)"
    return f"""logits AS (
  SELECT {key}, k, sum(x * {terms}) + {bias} AS logit FROM (
    SELECT {key}, CAST(unnest({vector}) AS DOUBLE) AS x, unnest(range({dim})) AS i FROM {source}),
    (SELECT unnest(range({len(LEVELS)})) AS k) GROUP BY {key}, k)"""
