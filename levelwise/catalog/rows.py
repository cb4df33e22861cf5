"""Queries over rows: sources, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx
from levelwise.catalog.registry import query
from levelwise.functions import scoring
from levelwise.functions.labels import (
    LEVEL_INFO, LEVELS, attach_level_info as attach_info, encode_labels, id_to_label as code_of, label_to_id as id_of,
    levels_dim as dimension,
)
from levelwise.functions.measures import signed_diff as signed
from levelwise.functions.text import clean_text as strip, text_preview as preview, words as words_of
from levelwise.operators import errors, requests as rq, weights as wt
from levelwise.operators.encode import encode_corpus as encode, learn_vocabulary as learn, real_tokens
from levelwise.operators.heavy_words import heavy_words
from levelwise.operators.pieces import encode_pieces as pieces_of
from levelwise.sources.exchange import read_requests, request_payloads, write_predictions
from levelwise.sources.labelled import prepare_labelled, read_labelled as read
from levelwise.sources.staging import staging_path

CODE_OF_Y = "['" + "','".join(LEVELS) + "'][y + 1]"
INFO_SQL = "info(label_id, code, name, description) AS (VALUES " + ", ".join(
    f"({i}, '{code}', '{name}', '{text}')" for i, (code, name, text) in enumerate(LEVEL_INFO)
) + ")"
CLEAN_SQL = f"trim(sentence, {fx.ASCII_SPACE})"


# --- sources and sinks -------------------------------------------------------

@query(f"WITH {fx.DOCS_SQL} SELECT id, text, {CODE_OF_Y} AS label, y AS label_id FROM level_docs")
def read_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as labelled CSV, read back and encoded."""
    path = staging_path(spark, "labelled-csv")
    fx.labelled_docs(spark, sf_dir).select("id", "text", "label").write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return prepare_labelled(read(spark, path, fmt="csv")).select("id", "text", "label", "label_id")


@query(f"""WITH {fx.DOCS_SQL}, {INFO_SQL}
SELECT i.label_id, i.code, i.name, i.description, count(d.id) AS n_docs
FROM info i LEFT JOIN level_docs d ON d.y = i.label_id GROUP BY ALL""")
def levels_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level dimension with the number of documents at each level."""
    counts = fx.level_docs(spark, sf_dir).groupBy(F.col("y").alias("label_id")).agg(F.count(F.lit(1)).alias("n"))
    return dimension(spark).join(counts, "label_id", "left").select(
        "label_id", "code", "name", "description", F.coalesce("n", F.lit(0)).alias("n_docs")
    )


@query(f"WITH {fx.REQUESTS_SQL} SELECT request_id::VARCHAR AS request_id, pos::INT AS pos, sentence FROM exploded")
def requests_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines, read back, one row per sentence."""
    path = staging_path(spark, "requests-json")
    request_payloads(fx.requests(spark, sf_dir)).write.text(path)
    return rq.requests_explode(read_requests(spark, path))


@query(f"""WITH {fx.PRED_SQL}
SELECT id, ['A1','A2','B1','B2','C1','C2'][p + 1] AS cefr, text AS sentence, confidence FROM level_pred""")
def predictions_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records written and read back."""
    path = staging_path(spark, "predictions")
    scored = fx.level_pred(spark, sf_dir).withColumn("cefr", code_of("p")).withColumnRenamed("text", "sentence")
    write_predictions(scored, path, "parquet", keep=("id",))
    return spark.read.parquet(path)


# --- projections -------------------------------------------------------------

@query(f"WITH {fx.DOCS_SQL} SELECT id, {CODE_OF_Y} AS label, y AS label_id FROM level_docs")
def label_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = fx.labelled_docs(spark, sf_dir).select("id", "label")
    return encode_labels(labelled).select("id", "label", "label_id")


@query(f"""WITH {fx.PRED_SQL}
SELECT id, p, ['A1','A2','B1','B2','C1','C2'][p + 1] AS level FROM level_pred""")
def id_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.level_pred(spark, sf_dir).select("id", "p", code_of("p").alias("level"))


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 END AS lang_id FROM documents""")
def label_to_id_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level list of the caller's own; values outside it have no id."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", id_of("lang", ("de", "en", "es")).alias("lang_id"))


@query(f"""WITH {fx.REQUESTS_SQL}
SELECT request_id, pos::INT AS pos, {CLEAN_SQL} AS cleaned, length({CLEAN_SQL}) AS n FROM exploded""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rq.requests_explode(fx.requests(spark, sf_dir))
    cleaned = strip("sentence")
    return rows.select("request_id", "pos", cleaned.alias("cleaned"), F.length(cleaned).cast("long").alias("n"))


@query(f"""WITH {fx.DOCS_SQL}
SELECT id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
FROM level_docs""")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.level_docs(spark, sf_dir).select("id", preview("text").alias("preview"))


VOCABULARY_SQL = f"""vocabulary AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INT) AS token_id, n FROM (
    SELECT token, count(*) AS n FROM (
      SELECT unnest({fx.WORDS_SQL.format(text='text')}) AS token FROM documents) GROUP BY token
    ORDER BY n DESC, token LIMIT {{size}}))"""

ENCODE_SQL = f"""WITH {VOCABULARY_SQL}, words AS (
  SELECT doc_id AS id, ({fx.WORDS_SQL.format(text='text')})[1:{{room}}] AS w FROM documents),
tokens AS (SELECT id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM words),
ids AS (
  SELECT t.id, list(COALESCE(v.token_id, 1) ORDER BY t.pos) AS body
  FROM tokens t LEFT JOIN vocabulary v USING (token) GROUP BY t.id),
encoded AS (
  SELECT w.id, list_concat(list_concat([2], COALESCE(i.body, []::INT[])), [3]) AS a
  FROM words w LEFT JOIN ids i USING (id))
SELECT id, len(a)::INT AS n_tokens,
       rtrim(array_to_string(a, ' ') || repeat(' 0', CAST({{length}} - len(a) AS INT))) AS input_ids
FROM encoded"""


def _encoded(spark: SparkSession, sf_dir: str, size: int, length: int) -> DataFrame:
    docs = fx.level_docs(spark, sf_dir)
    encoded = encode(docs, learn(docs, size), max_length=length)
    return encoded.select(
        "id", real_tokens().alias("n_tokens"), F.array_join("input_ids", " ").alias("input_ids")
    )


@query("WITH " + VOCABULARY_SQL.format(size=1000) + " SELECT token, token_id, n FROM vocabulary")
def learn_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,000 most frequent words of the corpus."""
    return learn(fx.level_docs(spark, sf_dir), 1000)


@query("WITH " + VOCABULARY_SQL.format(size=1000) + " SELECT token, token_id, n FROM vocabulary")
def heavy_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words from mergeable summaries and an exact count of their candidates."""
    return heavy_words(fx.level_docs(spark, sf_dir), 1000)


@query(ENCODE_SQL.format(size=200, room=14, length=16))
def encode_corpus_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, 200, 16)


@query(ENCODE_SQL.format(size=30000, room=126, length=128))
def encode_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-size vocabulary and the default length."""
    return _encoded(spark, sf_dir, 30000, 128)


CHARACTER_IDS = 100_000
PIECE_LENGTH = 32


@query(f"""WITH RECURSIVE {VOCABULARY_SQL.format(size=2000)}, words AS (
  SELECT doc_id AS id, ({fx.WORDS_SQL.format(text='text')})[1:{PIECE_LENGTH - 2}] AS w FROM documents),
tokens AS (SELECT id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM words),
different AS (SELECT DISTINCT token AS word FROM tokens),
pieces AS (
  SELECT token, token_id FROM vocabulary
  UNION ALL SELECT DISTINCT c, ({CHARACTER_IDS} + unicode(c))::INT FROM (SELECT unnest(string_split(word, '')) AS c FROM different)
  WHERE c NOT IN (SELECT token FROM vocabulary)),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM different),
longest AS (
  SELECT word, place, max(length(p.token)) AS n, arg_max(p.token_id, length(p.token)) AS token_id
  FROM (SELECT word, place, unnest(range(1, least(length(word) - place + 1, (SELECT max(length(token)) FROM pieces)) + 1)) AS size FROM places) c
  JOIN pieces p ON p.token = substr(c.word, c.place, c.size) GROUP BY word, place),
walk(word, place, ids) AS (
  SELECT word, 1::BIGINT, []::INT[] FROM different
  UNION ALL SELECT k.word, k.place + l.n, list_append(k.ids, l.token_id) FROM walk k JOIN longest l ON l.word = k.word AND l.place = k.place),
cut AS (SELECT word, ids FROM walk WHERE place > length(word)),
joined AS (
  SELECT t.id, flatten(list(c.ids ORDER BY t.pos)) AS body FROM tokens t JOIN cut c ON c.word = t.token GROUP BY t.id),
encoded AS (
  SELECT w.id, list_concat(list_concat([2], COALESCE(j.body, []::INT[])[1:{PIECE_LENGTH - 2}]), [3]) AS a
  FROM words w LEFT JOIN joined j USING (id))
SELECT id, len(a)::INT AS n_tokens,
       rtrim(array_to_string(a, ' ') || repeat(' 0', CAST({PIECE_LENGTH} - len(a) AS INT))) AS input_ids
FROM encoded""")
def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut into the longest of given pieces: frequent words and single characters."""
    docs = fx.level_docs(spark, sf_dir)
    whole = learn(docs, 2000).select("token", "token_id")
    seen = docs.select(F.explode(F.array_distinct(F.split(F.concat_ws("", F.slice(words_of("text"), 1, PIECE_LENGTH - 2)), ""))).alias("token"))
    seen = seen.where(F.col("token") != "").distinct().join(whole, "token", "left_anti")
    # One row per character: as many as the scripts have.
    numbered = [(r["token"], CHARACTER_IDS + ord(r["token"])) for r in seen.collect()]
    characters = spark.createDataFrame(numbered, "token string, token_id int")
    encoded = pieces_of(docs, whole.union(characters), max_length=PIECE_LENGTH)
    return encoded.select("id", real_tokens().alias("n_tokens"), F.array_join("input_ids", " ").alias("input_ids"))


HEAD = fx.head_sql("embeddings", "vec_id", "embedding", fx.DIM)
PROB_SQL = f"""{HEAD}, probs AS (
  SELECT vec_id, k, logit, exp(logit - max(logit) OVER (PARTITION BY vec_id))
         / sum(exp(logit - m)) OVER (PARTITION BY vec_id) AS p
  FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM logits))"""


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = scoring.linear_head("embedding", fx.fixed_head(fx.DIM))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", head.alias("logits"))


@query(f"WITH {HEAD} SELECT vec_id, k::INT AS k, round(logit, 6) AS logit FROM logits")
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", F.posexplode("logits").alias("k", "logit")).withColumn(
        "logit", F.round("logit", 6))


@query(f"WITH {PROB_SQL} SELECT vec_id, k::INT AS k, round(p, 6) AS p FROM probs")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = _logits(spark, sf_dir).withColumn("probs", scoring.softmax("logits", len(LEVELS)))
    return probs.select("vec_id", F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 6))


@query(f"WITH {PROB_SQL} SELECT vec_id, round(max(p), 6) AS confidence FROM probs GROUP BY vec_id")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select(
        "vec_id", F.round(scoring.confidence(scoring.softmax("logits", len(LEVELS))), 6).alias("confidence"))


@query(f"""WITH {HEAD}
SELECT vec_id, CAST(arg_min(k, -round(logit, 9)) AS INT) AS pred_id FROM
  (SELECT * FROM logits ORDER BY vec_id, k) GROUP BY vec_id""")
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", scoring.argmax_label("logits").alias("pred_id"))


@query(f"WITH {fx.PRED_SQL} SELECT id, y, p, p = y AS correct FROM level_pred")
def correct_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.level_pred(spark, sf_dir).select("id", "y", "p", scoring.correct_flag().alias("correct"))


@query("""SELECT source, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM documents), 1) AS pct
FROM documents GROUP BY source""")
def pct_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and their share."""
    return wt.counts_with_pct(fx.table(spark, sf_dir, "documents"), "source")


@query(f"""WITH {fx.PRED_SQL}
SELECT id, p - y AS diff, CASE WHEN p > y THEN '+' ELSE '' END || CAST(p - y AS VARCHAR) AS diff_text FROM level_pred""")
def signed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.level_pred(spark, sf_dir).select(
        "id", (F.col("p") - F.col("y")).alias("diff"), signed(F.col("p"), F.col("y")).alias("diff_text"))


# --- filters -----------------------------------------------------------------

@query(f"WITH {fx.REQUESTS_SQL} SELECT request_id, pos::INT AS pos, sentence FROM exploded WHERE {CLEAN_SQL} <> ''")
def filter_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.filter_blank(rq.requests_explode(fx.requests(spark, sf_dir)))


@query(f"""WITH residue AS (
  SELECT doc_id AS request_id, list_filter(
           string_split(regexp_replace(text, '[A-Za-z.,]', '', 'g'), chr(10)), lambda s: s <> '') AS sentences
  FROM documents)
SELECT request_id, CASE WHEN len(sentences) = 0 THEN 'no_sentences'
  WHEN len(list_filter(sentences, lambda s: trim(s, {fx.ASCII_SPACE}) <> '')) = 0 THEN 'no_valid_sentences'
  ELSE 'ok' END AS status FROM residue""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.request_status(fx.residue_requests(spark, sf_dir)).select("request_id", "status")


@query(f"WITH {fx.PRED_SQL} SELECT id, y, p, confidence FROM level_pred WHERE p <> y")
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.misclassified(fx.level_pred(spark, sf_dir)).select("id", "y", "p", "confidence")


# --- joins -------------------------------------------------------------------

@query(f"""WITH {fx.PRED_SQL}
SELECT d.id, d.y, r.p, r.confidence, r.p = d.y AS correct, CAST(NULL AS VARCHAR) AS missing,
       CASE WHEN length(d.text) > 100 THEN substring(d.text, 1, 100) || '...' ELSE d.text END AS preview
FROM level_docs d JOIN level_pred r ON r.id = d.id""")
def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth joined with predictions by id; only the short preview travels."""
    truth = fx.level_docs(spark, sf_dir).select("id", "y", preview("text").alias("preview"))
    predicted = fx.level_pred(spark, sf_dir).select("id", "p", "confidence")
    return errors.align_predictions(truth, predicted)


@query(f"""WITH {fx.PRED_SQL}, {INFO_SQL}
SELECT r.id, i.code AS cefr, i.name, i.description FROM level_pred r JOIN info i ON i.label_id = r.p""")
def attach_level_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = fx.level_pred(spark, sf_dir).select("id", code_of("p").alias("cefr"))
    return attach_info(predicted).select("id", "cefr", "name", "description")
