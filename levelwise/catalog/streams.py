"""Queries over streams, restartable fits, files split before, bucketed tables, epochs and display."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx, models
from levelwise.catalog.aggregates import REPORT_SQL, rounded
from levelwise.catalog.registry import query
from levelwise.catalog.rows import CODE_OF_Y
from levelwise.functions.labels import LEVELS
from levelwise.operators.errors import align_predictions, bucket_count, write_bucketed
from levelwise.operators.metrics import classification_report, confusion_cells
from levelwise.operators.permutation import hash_positions, with_place
from levelwise.operators.requests import score_requests
from levelwise.plans import fit as ft, training as tr
from levelwise.plans.report import formatted_report
from levelwise.sources.labelled import prepare_labelled, read_labelled
from levelwise.sources.staging import stage, staging_path
from levelwise.streaming import evaluate_stream as es
from levelwise.streaming.prediction_sink import sink_predictions
from levelwise.streaming.score_stream import request_stream

LATE_DAYS = 7
# Micro-batches of the request log, and about how many bytes of it make a file.
BATCHES, FILE_BYTES = 3, 64 << 20


@query(f"WITH {fx.DOCS_SQL} SELECT id, text, {CODE_OF_Y} AS label, y AS label_id FROM level_docs")
def read_labelled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV with newlines inside fields, read back in splits."""
    path = staging_path(spark, "labelled-csv")
    fx.labelled_docs(spark, sf_dir).select("id", "text", "label").write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return prepare_labelled(read_labelled(spark, path, fmt="csv", multi_line="split")).select("id", "text", "label", "label_id")


@query(f"SELECT request_id, pos, cefr, sentence, confidence FROM ({models.LOG_SQL}) WHERE status = 'ok'")
def predictions_stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as a stream of several micro-batches, its predictions written by batch and read back."""
    incoming, output, checkpoint = (staging_path(spark, n) for n in ("stream-in", "stream-sink", "stream-checkpoint"))
    # A batch has as many files as its share of the text needs, so that no task's share grows with it.
    size = fx.documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // (BATCHES * FILE_BYTES)))
    fx.request_lines(spark, sf_dir).repartition(BATCHES * files).write.text(incoming)
    scored = score_requests(request_stream(spark, incoming, max_files=files), models._score_sentences)
    sink_predictions(scored, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).select("request_id", "pos", "cefr", "sentence", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {fx.PRED_SQL}, {fx.LEVELS_SQL}, timely AS (SELECT * FROM level_pred WHERE id % 10 <= {LATE_DAYS}),
stats AS (
  SELECT l.label_id, count(*) FILTER (y = l.label_id AND p = l.label_id) AS tp,
         count(*) FILTER (y = l.label_id) AS support, count(*) FILTER (p = l.label_id) AS predicted
  FROM levels l, timely GROUP BY l.label_id)
SELECT sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(avg((2 * tp)::DOUBLE / (support + predicted)) FILTER (support + predicted > 0), 6) AS macro_f1 FROM stats""")
def evaluate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and their truth as two streams; truth that comes more than seven days later does not count."""
    shown, known, cells, checkpoint = (staging_path(spark, n) for n in ("shown", "known", "cells", "stream-checkpoint"))
    rows = fx.level_pred(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    rows.select("id", "p", at.alias("at")).write.parquet(shown)
    rows.select("id", "y", (at + F.make_dt_interval(days=(F.col("id") % 10).cast("int"))).alias("at")).write.parquet(known)
    streams = [spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) for path in (shown, known)]
    es.evaluate_stream(*streams, cells, checkpoint, late=f"{LATE_DAYS} days").awaitTermination()
    return rounded(es.stream_evaluation(spark, cells), "accuracy", "macro_f1")


@query("SELECT unnest([1, 2])::INT AS candidate, true AS same, true AS useful")
def fit_classifier_resumed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that finds its candidates finished gives the history of the first one; both candidates beat the largest class."""
    folder = staging_path(spark, "fit-log")
    parts = tr.split_labelled(fx.labelled_docs(spark, sf_dir), settings=models.TWO_CANDIDATES, allow_rare=True)
    first, second = (ft.fit_parts(parts, models.TWO_CANDIDATES, resume=folder).history_table(spark) for _ in range(2))
    per_class = parts.where(F.col("split") == "val").groupBy("label_id").count()
    share = per_class.agg(F.max("count") / F.sum("count")).first()[0]
    again = second.select(*[F.col(c).alias(f"{c}_again") for c in second.columns])
    same = (F.col("loss") == F.col("loss_again")) & (F.col("macro_f1") == F.col("macro_f1_again"))
    return first.join(again, F.col("candidate") == F.col("candidate_again")).select("candidate", same.alias("same"), (F.col("accuracy") > share).alias("useful"))


TEST_EVERY = 5


@query(f"""WITH {fx.DOCS_SQL}, {fx.LEVELS_SQL}, test AS (SELECT y, count(*) AS n FROM level_docs WHERE id % {TEST_EVERY} = 0 GROUP BY y)
SELECT 'support ' || l.code AS item, coalesce(t.n, 0)::BIGINT AS n FROM levels l LEFT JOIN test t ON t.y = l.label_id
UNION ALL SELECT 'confusion', sum(n)::BIGINT FROM test
UNION ALL SELECT 'train and val', count(*) FROM level_docs WHERE id % {TEST_EVERY} <> 0
UNION ALL SELECT 'better than the largest class', 1""")
def train_on_files_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelled files, one to fit and one to report on: supports, totals, and whether anything was learned."""
    rows, paths = fx.labelled_docs(spark, sf_dir).select("id", "text", "label"), [staging_path(spark, n) for n in ("train-file", "test-file")]
    for path, part in zip(paths, (F.col("id") % TEST_EVERY != 0, F.col("id") % TEST_EVERY == 0)):
        rows.where(part).write.parquet(path)
    run = tr.train_on_files(spark, *paths, models.ONE_CANDIDATE, fmt="parquet", allow_rare=True)
    named = run.report["classification_report"].where(F.col("name").isin(*LEVELS))
    support = named.select(F.concat(F.lit("support "), "name").alias("item"), F.col("support").cast("long").alias("n"))
    total = run.report["confusion_matrix"].agg(F.sum("n").alias("n")).select(F.lit("confusion").alias("item"), "n")
    fitted = run.split_sizes.where(F.col("split") != "test").agg(F.sum("n").alias("n")).select(F.lit("train and val").alias("item"), "n")
    share = named.agg(F.max("support") / F.sum("support")).first()[0]
    learned = run.report["overall"].select(F.lit("better than the largest class").alias("item"), (F.col("accuracy") > share).cast("long").alias("n"))
    return support.union(total).union(fitted).union(learned)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{text}', true)" for i, text in enumerate(tr.DEMO_TEXTS)) + ") AS t(pos, sentence, scored)")
def demo_predictions_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample sentence has a level and a confidence that is that of the largest of six probabilities."""
    scored = tr.demo_predictions(spark, models._fit(spark, sf_dir))
    fits = F.col("cefr").isin(*LEVELS) & F.col("confidence").between(1.0 / len(LEVELS), 1.0)
    return scored.select("pos", "sentence", fits.alias("scored"))


@query(f"""WITH {fx.STATS_SQL}, {REPORT_SQL}
SELECT position::INT AS position, name, coalesce(printf('%.4f', "precision"), '') AS "precision", coalesce(printf('%.4f', recall), '') AS recall,
       coalesce(printf('%.4f', f1), '') AS f1, support::VARCHAR AS support FROM report""")
def format_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class report with fixed decimals."""
    return formatted_report(classification_report(confusion_cells(fx.level_pred(spark, sf_dir))))


@query(f"""WITH {fx.PRED_SQL}
SELECT id, y, p, confidence, p = y AS correct, CAST(NULL AS VARCHAR) AS missing FROM level_pred""")
def align_predictions_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predictions kept in buckets by id and joined without moving a row."""
    rows, tag = fx.level_pred(spark, sf_dir), uuid.uuid4().hex
    buckets = bucket_count(rows.count())
    truth = write_bucketed(rows.select("id", "y"), f"truth_{tag}", staging_path(spark, "truth"), buckets)
    predicted = write_bucketed(rows.select("id", "p", "confidence"), f"predicted_{tag}", staging_path(spark, "predicted"), buckets)
    return align_predictions(truth, predicted)


@query("""WITH placed AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents),
epochs AS (SELECT *, unnest([0, 1]) AS epoch FROM placed)
SELECT id, epoch::INT AS epoch, position, true AS inside, n AS places, true AS moved FROM epochs""")
def shuffle_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all documents and facts of two epochs' orders: as many different places as rows, all within them."""
    positioned, n = hash_positions(fx.level_docs(spark, sf_dir).select("id"))
    positioned = stage(positioned, "positions")
    both = with_place(positioned, n, 0).withColumn("epoch", F.lit(0)).union(with_place(positioned, n, 1).withColumn("epoch", F.lit(1)))
    facts = both.groupBy("epoch").agg(F.countDistinct("place").alias("places"), F.avg((F.col("place") != F.col("position")).cast("int")).alias("share"))
    return both.join(F.broadcast(facts), "epoch").select(
        "id", "epoch", "position", F.col("place").between(0, n - 1).alias("inside"), "places", (F.col("share") > 0.5).alias("moved"))
