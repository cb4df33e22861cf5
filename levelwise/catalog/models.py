"""Queries that fit or apply a scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx
from levelwise.catalog.registry import query
from levelwise.functions.labels import LEVELS
from levelwise.operators import pooling, requests as rq, score as sc
from levelwise.operators.encoder import embedding_projection, score_encoded as score_by_encoder
from levelwise.plans import fit as ft, training as tr
from levelwise.plans.report import report_rows
from levelwise.sources.exchange import parse_requests
from levelwise.sources.staging import staging_path
from levelwise.streaming.score_stream import request_stream, score_stream as start_scoring

TWO_CANDIDATES = ft.FitSettings(
    candidates=({"regParam": 0.1, "maxIter": 10}, {"regParam": 0.01, "maxIter": 20}))
ONE_CANDIDATE = ft.FitSettings()
POOLED = ft.FitSettings(features="embedding", dim=16)
VECTOR_DIM, VECTOR_WORDS = 16, 5000

CODE_OF_PRED = "['" + "','".join(LEVELS) + "'][pred_id + 1]"
BEST_SQL = """best AS (
  SELECT {key}, arg_min(k, -round(logit, 9))::INT AS pred_id, 1.0::DOUBLE / sum(exp(logit - m)) AS confidence FROM (
    SELECT *, max(logit) OVER (PARTITION BY {key}) AS m FROM logits ORDER BY {key}, k) GROUP BY {key})"""


def _fit(spark: SparkSession, sf_dir: str, settings: ft.FitSettings = ONE_CANDIDATE) -> ft.FittedClassifier:
    parts = tr.split_labelled(fx.labelled_docs(spark, sf_dir), settings=settings, allow_rare=True)
    return ft.fit_parts(parts, settings)


@query()
def fit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of two candidates fitted on the length levels."""
    return _fit(spark, sf_dir, TWO_CANDIDATES).history_table(spark)


@query()
def fit_classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a fit on the two-level quality label of the given tables."""
    settings = ft.FitSettings(levels=("0", "1"))
    labelled = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("quality").alias("label_id"))
    parts = tr.split_labelled(labelled, settings=settings, allow_rare=True)
    return ft.fit_parts(parts, settings).history_table(spark)


@query()
def fit_classifier_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a fit on the mean of word vectors learned with it."""
    return _fit(spark, sf_dir, POOLED).history_table(spark)


@query()
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a fitted model."""
    fitted = _fit(spark, sf_dir)
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    return sc.score_table(fitted.model, docs).select("id", "sentence", "cefr", "confidence")


@query()
def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model that was fitted, saved and loaded."""
    path = staging_path(spark, "model")
    ft.fit_or_load(spark, path, lambda: _fit(spark, sf_dir))
    loaded = ft.load_classifier(spark, path, LEVELS)
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    return sc.score_table(loaded.model, docs).select("id", "cefr", "confidence")


@query(f"""WITH {fx.head_sql("embeddings", "vec_id", "embedding", fx.DIM)}, {BEST_SQL.format(key="vec_id")}
SELECT vec_id, pred_id, {CODE_OF_PRED} AS cefr, round(confidence, 6) AS confidence FROM best""")
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sc.score_linear(
        fx.table(spark, sf_dir, "embeddings"), fx.fixed_head(fx.DIM), features="embedding")
    return scored.select("vec_id", "pred_id", "cefr", F.round("confidence", 6).alias("confidence"))


PROJECTED = 8
PROJECTION_SQL = f"""projected AS (
  SELECT vec_id, list(v ORDER BY j) AS f FROM (
    SELECT vec_id, j, sum(x * (CAST((j * 29 + i * 11) % 17 - 8 AS DOUBLE) / 8.0::DOUBLE)) AS v FROM (
      SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range({fx.DIM})) AS i FROM embeddings),
      (SELECT unnest(range({PROJECTED})) AS j) GROUP BY vec_id, j) GROUP BY vec_id)"""


@query(f"""WITH {PROJECTION_SQL}, {fx.head_sql("projected", "vec_id", "f", PROJECTED, "sqrt(k + 1) / 1000.0::DOUBLE")},
{BEST_SQL.format(key="vec_id")}
SELECT vec_id, pred_id, {CODE_OF_PRED} AS cefr, round(confidence, 6) AS confidence FROM best""")
def score_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors passed through an encoder of the caller's own and scored by a fixed head."""
    weights = [[((j * 29 + i * 11) % 17 - 8) / 8.0 for i in range(fx.DIM)] for j in range(PROJECTED)]
    scored = score_by_encoder(
        fx.table(spark, sf_dir, "embeddings"), embedding_projection(weights), fx.fixed_head(PROJECTED), fx.sentence_bias(), "embedding")
    return scored.select("vec_id", "pred_id", "cefr", F.round("confidence", 6).alias("confidence"))


def _score_sentences(rows: DataFrame) -> DataFrame:
    return sc.score_linear(rows.withColumn("features", fx.sentence_features()), fx.fixed_head(4), fx.sentence_bias())


SCORED_SQL = f"""WITH {fx.REQUESTS_SQL},
cleaned AS (SELECT request_id, pos, trim(sentence, {fx.ASCII_SPACE}) AS sentence FROM exploded),
valid AS (SELECT * FROM cleaned WHERE sentence <> ''),
features AS (
  SELECT request_id, pos, [length(sentence) / 100.0::DOUBLE,
         len({fx.WORDS_SQL.format(text='sentence')}) / 10.0::DOUBLE,
         length(regexp_replace(sentence, '[^aeiou]', '', 'g')) / 50.0::DOUBLE,
         length(regexp_replace(sentence, '[^,]', '', 'g'))::DOUBLE] AS f FROM valid),
{fx.head_sql("features", "request_id, pos", "f", 4, "sqrt(k + 1) / 1000.0::DOUBLE")},
{BEST_SQL.format(key="request_id, pos")}
SELECT b.request_id, b.pos::INT AS pos, v.sentence, {CODE_OF_PRED} AS cefr, round(b.confidence, 6) AS confidence,
       'ok' AS status, CAST(NULL AS VARCHAR) AS raw
FROM best b JOIN valid v ON v.request_id = b.request_id AND v.pos = b.pos"""
LOG_SQL = f"""SELECT s.request_id::VARCHAR AS request_id, s.* EXCLUDE (request_id)
FROM ({SCORED_SQL}) s JOIN documents d ON d.doc_id = s.request_id WHERE d.lang NOT IN ('de', 'es')
UNION ALL
SELECT CASE WHEN lang = 'es' THEN doc_id::VARCHAR END, NULL, NULL, NULL, NULL,
       CASE WHEN lang = 'es' THEN 'no_sentences' ELSE 'malformed' END,
       CASE WHEN lang = 'de' THEN '{{' || doc_id END
FROM documents WHERE lang IN ('de', 'es')"""


@query(SCORED_SQL)
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every request scored by a fixed head."""
    scored = rq.score_requests(fx.requests(spark, sf_dir), _score_sentences)
    return scored.withColumn("confidence", F.round("confidence", 6))


@query(LOG_SQL)
def score_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of request lines, some of them refused: every request has an outcome."""
    scored = rq.score_requests(parse_requests(fx.request_lines(spark, sf_dir)), _score_sentences)
    return scored.withColumn("confidence", F.round("confidence", 6))


@query(LOG_SQL)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream of files."""
    incoming, output, checkpoint = (staging_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    fx.request_lines(spark, sf_dir).write.text(incoming)
    start_scoring(request_stream(spark, incoming), _score_sentences, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).withColumn("confidence", F.round("confidence", 6))


@query()
def score_requests_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every request scored by a fitted model."""
    fitted = _fit(spark, sf_dir)
    return rq.score_requests(fx.requests(spark, sf_dir), lambda rows: sc.score_table(fitted.model, rows))


@query()
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the mean of word vectors learned from them."""
    docs = fx.level_docs(spark, sf_dir)
    vectors = ft.learn_token_vectors(docs, VECTOR_WORDS, VECTOR_DIM)
    return pooling.embed_text(docs, vectors, VECTOR_DIM, buckets=ft.VECTOR_BUCKETS)


@query()
def demo_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample sentences, scored by a model fitted on the documents."""
    return tr.demo_predictions(spark, _fit(spark, sf_dir))


@query()
def train_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job; its report on the test rows as one long table."""
    run = tr.train_and_evaluate(fx.labelled_docs(spark, sf_dir), ONE_CANDIDATE, allow_rare=True)
    return report_rows(run.report)
