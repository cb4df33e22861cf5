"""Queries over fitted models that state what does not depend on the fitted weights, so that SQL can agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx, models
from levelwise.catalog.aggregates import SPLIT_SQL
from levelwise.catalog.registry import QUERIES, query
from levelwise.functions.labels import LEVELS, id_to_label
from levelwise.functions.scoring import argmax_label
from levelwise.functions.text import words
from levelwise.operators import requests as rq, score as sc
from levelwise.plans import fit as ft, training as tr
from levelwise.sources.staging import stage, staging_path


def _score_facts(spark: SparkSession, sf_dir: str, settings: ft.FitSettings) -> DataFrame:
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    scored = sc.score_table(models._fit(spark, sf_dir, settings).model, docs)
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    fits = (F.col("confidence") == F.array_max("probability")) & (F.col("confidence") >= 1.0 / len(LEVELS)) & (F.abs(total - 1.0) < 1e-9)
    return scored.select(
        "id", "sentence", (F.col("cefr") == id_to_label(argmax_label("probability"))).alias("level_is_largest"), fits.alias("confidence_fits"))


SCORE_FACTS_SQL = f"WITH {fx.DOCS_SQL} SELECT id, text AS sentence, true AS level_is_largest, true AS confidence_fits FROM level_docs"


@query(SCORE_FACTS_SQL)
def score_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document keeps its text; its level is that of the largest probability, which is the confidence."""
    return _score_facts(spark, sf_dir, models.ONE_CANDIDATE)


@query(SCORE_FACTS_SQL)
def fit_classifier_embedding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a model on pooled word vectors."""
    return _score_facts(spark, sf_dir, models.POOLED)


@query(f"WITH {fx.DOCS_SQL} SELECT id, true AS same FROM level_docs")
def saved_model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that was saved and loaded scores every document as the one in memory."""
    path, fitted = staging_path(spark, "model"), models._fit(spark, sf_dir)
    ft.save_classifier(fitted, path)
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    first, second = (
        sc.score_table(m.model, docs).select("id", F.struct("cefr", "probability").alias(name))
        for m, name in ((fitted, "a"), (ft.load_classifier(spark, path, LEVELS), "b"))
    )
    return stage(first, "scores").join(second, "id").select("id", (F.col("a") == F.col("b")).alias("same"))


@query(f"""WITH {fx.REQUESTS_SQL}
SELECT request_id, pos::INT AS pos, trim(sentence, {fx.ASCII_SPACE}) AS sentence, true AS scored
FROM exploded WHERE trim(sentence, {fx.ASCII_SPACE}) <> ''""")
def score_requests_fitted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each valid sentence of each request has a level and a confidence from the fitted model."""
    fitted = models._fit(spark, sf_dir)
    rows = rq.score_requests(fx.requests(spark, sf_dir), lambda r: sc.score_table(fitted.model, r))
    scored = F.col("cefr").isin(*LEVELS) & F.col("confidence").between(1.0 / len(LEVELS), 1.0)
    return rows.select("request_id", "pos", "sentence", scored.alias("scored"))


@query(f"""SELECT doc_id AS id, len({fx.WORDS_SQL.format(text='text')})::INT AS n_words,
len({fx.WORDS_SQL.format(text='text')}) > 0 AS has_vector FROM documents""")
def embed_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document has a vector of its own exactly if it has a word: no word is lost."""
    pooled = QUERIES["embed_text"](spark, sf_dir)
    counted = fx.level_docs(spark, sf_dir).select("id", F.size(words("text")).alias("n_words"))
    return pooled.join(counted, "id").select("id", "n_words", F.exists("pooled", lambda x: x != 0).alias("has_vector"))


@query(f"""WITH {SPLIT_SQL}, {fx.LEVELS_SQL}, tested AS (SELECT y, count(*) AS n FROM splits WHERE split = 'test' GROUP BY y)
SELECT 'support ' || l.code AS item, coalesce(t.n, 0)::BIGINT AS n FROM levels l LEFT JOIN tested t ON t.y = l.label_id
UNION ALL SELECT 'split ' || split, count(*) FROM splits GROUP BY split
UNION ALL SELECT 'confusion', sum(n)::BIGINT FROM tested UNION ALL SELECT 'scored', sum(n)::BIGINT FROM tested""")
def train_and_evaluate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports, split sizes and totals of the whole job."""
    run = tr.train_and_evaluate(fx.labelled_docs(spark, sf_dir), models.ONE_CANDIDATE, allow_rare=True)
    support = run.report["classification_report"].where(F.col("name").isin(*LEVELS)).select(
        F.concat(F.lit("support "), "name").alias("item"), F.col("support").alias("n"))
    sizes = run.split_sizes.select(F.concat(F.lit("split "), "split").alias("item"), "n")
    confusion = run.report["confusion_matrix"].agg(F.sum("n").alias("n")).select(F.lit("confusion").alias("item"), "n")
    scored = run.scored_test.agg(F.countDistinct("id").alias("n")).select(F.lit("scored").alias("item"), "n")
    return support.union(sizes).union(confusion).union(scored)


@query(f"""WITH {SPLIT_SQL}, parts AS (SELECT count(*) FILTER (WHERE split = 'val') AS n_val FROM splits)
SELECT unnest([1, 2])::INT AS candidate, n_val, true AS whole_rows FROM parts""")
def fit_classifier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both candidates are judged on exactly the validation rows: accuracy times their number is a whole number."""
    parts = tr.split_labelled(fx.labelled_docs(spark, sf_dir), settings=models.TWO_CANDIDATES, allow_rare=True)
    history = ft.fit_parts(parts, models.TWO_CANDIDATES).history_table(spark)
    n_val = F.lit(parts.where(F.col("split") == "val").count()).cast("long")
    right = F.col("accuracy") * n_val
    return history.select("candidate", n_val.alias("n_val"), ((F.abs(right - F.round(right)) < 1e-6) & F.col("macro_f1").between(0.0, 1.0)).alias("whole_rows"))
