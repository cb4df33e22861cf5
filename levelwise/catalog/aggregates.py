"""Queries that aggregate, rank or select."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx
from levelwise.catalog.registry import query
from levelwise.functions.labels import LEVELS
from levelwise.operators import errors, metrics, pooling, selection, split as sp, weights as wt
from levelwise.operators.encode import learn_vocabulary
from levelwise.plans import report as rp

RATIOS_SQL = f"""{fx.DOCS_SQL}, {fx.LEVELS_SQL}, ratios AS (
  SELECT y, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM level_docs) AS r FROM level_docs GROUP BY y),
weights AS (
  SELECT l.label_id, COALESCE(
    pow(r.r, 0.5::DOUBLE) / (SELECT sum(pow(r, 0.5::DOUBLE)) FROM ratios) / (r.r + 1e-5::DOUBLE), 1.0::DOUBLE) AS weight
  FROM levels l LEFT JOIN ratios r ON r.y = l.label_id)"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda d, name: d.withColumn(name, F.round(name, 6)), names, df)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.level_docs(spark, sf_dir).withColumnRenamed("y", "label_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_cells(fx.level_pred(spark, sf_dir))


# --- class statistics --------------------------------------------------------

@query(f"WITH {fx.DOCS_SQL} SELECT ['A1','A2','B1','B2','C1','C2'][y + 1] AS label, count(*) AS n FROM level_docs GROUP BY y")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wt.label_counts(fx.labelled_docs(spark, sf_dir))


@query(f"WITH {RATIOS_SQL} SELECT y AS label_id, n, round(r, 6) AS ratio FROM ratios")
def class_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.class_ratios(_docs(spark, sf_dir)), "ratio")


@query(f"WITH {RATIOS_SQL} SELECT label_id, round(weight, 6) AS weight FROM weights")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.class_weights(_docs(spark, sf_dir)), "weight")


@query("""WITH r AS (
  SELECT quality, count(*)::DOUBLE / (SELECT count(*) FROM labels) AS r FROM labels GROUP BY quality)
SELECT quality AS label_id,
       round(pow(r, 0.5::DOUBLE) / (SELECT sum(pow(r, 0.5::DOUBLE)) FROM r) / (r + 1e-5::DOUBLE), 6) AS weight FROM r""")
def class_weights_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights for the imbalanced two-level quality label."""
    return rounded(wt.class_weights(fx.table(spark, sf_dir, "labels"), "quality", ("0", "1")), "weight")


@query(f"""WITH {RATIOS_SQL}
SELECT d.id, d.y AS label_id, round(w.weight, 6) AS weight FROM level_docs d JOIN weights w ON w.label_id = d.y""")
def attach_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return rounded(wt.attach_class_weight(docs.select("id", "label_id"), wt.class_weights(docs)), "weight")


@query(f"""WITH {RATIOS_SQL}, losses AS (
  SELECT w.weight, -ln((CAST((d.id * 37) % 101 AS DOUBLE) + 1) / 102.0::DOUBLE) AS loss
  FROM level_docs d JOIN weights w ON w.label_id = d.y)
SELECT round(sum(weight * loss) / sum(weight), 6) AS log_loss FROM losses""")
def weighted_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    p_true = (((F.col("id") * 37) % 101).cast("double") + 1.0) / 102.0
    weighted = wt.attach_class_weight(docs.select("label_id", p_true.alias("p_true")), wt.class_weights(docs))
    return rounded(metrics.weighted_log_loss(weighted), "log_loss")


# --- splitting ---------------------------------------------------------------

SPLIT_SQL = f"""{fx.DOCS_SQL}, counts AS (SELECT y, count(*)::HUGEINT AS n FROM level_docs GROUP BY y),
totals AS (SELECT sum(n)::HUGEINT AS n_all, ceil(sum(n) * 30 / 100.0)::HUGEINT AS n_hold FROM counts),
t1 AS (
  SELECT y, n, n_hold, n * (n_all - n_hold) // n_all AS base,
         row_number() OVER (ORDER BY n * (n_all - n_hold) % n_all DESC, y) AS pri, n_all - n_hold AS draws
  FROM counts, totals),
t2 AS (
  SELECT y, n, n_hold, base + CASE WHEN pri <= draws - (SELECT sum(base) FROM t1) THEN 1 ELSE 0 END AS train FROM t1),
v1 AS (
  SELECT y, n, train, n - train AS held, n_hold - ceil(n_hold * 50 / 100.0)::HUGEINT AS draws, n_hold FROM t2),
v2 AS (
  SELECT *, held * draws // n_hold AS base, row_number() OVER (ORDER BY held * draws % n_hold DESC, y) AS pri FROM v1),
quotas AS (
  SELECT y, n, train, base + CASE WHEN pri <= draws - (SELECT sum(base) FROM v2) THEN 1 ELSE 0 END AS val FROM v2),
ranked AS (
  SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || CAST(id AS VARCHAR)), id) AS rn FROM level_docs),
splits AS (
  SELECT r.id, r.y, CASE WHEN rn <= q.train THEN 'train' WHEN rn <= q.train + q.val THEN 'val' ELSE 'test' END AS split
  FROM ranked r JOIN quotas q USING (y))"""


@query(f"WITH {SPLIT_SQL} SELECT id, y AS label_id, split FROM splits")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(_docs(spark, sf_dir).select("id", "label_id"))


@query(f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM splits), 1) AS pct
FROM splits GROUP BY split""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wt.counts_with_pct(sp.stratified_split(_docs(spark, sf_dir).select("id", "label_id")), "split")


@query(f"""WITH {SPLIT_SQL}
SELECT y AS label_id, n::BIGINT AS n, train::BIGINT AS train, val::BIGINT AS val, (n - train - val)::BIGINT AS test
FROM quotas""")
def stratified_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _docs(spark, sf_dir).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.stratified_quotas(counts)


@query(f"WITH {fx.DOCS_SQL} SELECT id, y, md5('42-' || CAST(id AS VARCHAR)) AS shuffle_key FROM level_docs")
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.shuffle_rows(fx.level_docs(spark, sf_dir).select("id", "y"))


# --- pooling -----------------------------------------------------------------

@query(f"""WITH t AS (
  SELECT label, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, CAST(unnest(embedding) AS DOUBLE) AS x,
         unnest(range({fx.DIM})) AS i FROM embeddings)
SELECT label, i::INT AS i, round(sum(m * x) / greatest(sum(m)::DOUBLE, 1e-9::DOUBLE), 6) AS value
FROM t GROUP BY label, i""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled vector per label over the long table of vectors."""
    tokens = fx.table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = pooling.mean_pool(tokens, fx.DIM, "label", "embedding", "mask")
    return rounded(pooled.select("label", F.posexplode("pooled").alias("i", "value")), "value")


@query("""WITH t AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS j FROM embeddings),
masked AS (SELECT vec_id, j % 8 AS i, x, CASE WHEN (vec_id + j // 8) % 3 <> 0 THEN 1 ELSE 0 END AS m FROM t)
SELECT vec_id, i::INT AS i, round(sum(m * x) / greatest(sum(m)::DOUBLE, 1e-9::DOUBLE), 6) AS value
FROM masked GROUP BY vec_id, i""")
def mean_pool_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector read as eight tokens of eight numbers, pooled inside its row."""
    positions = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(positions, lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    mask = F.transform(positions, lambda t: ((F.col("vec_id") + t) % 3 != 0).cast("int"))
    pooled = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", pooling.mean_pool_nested(tokens, mask, 8).alias("pooled"))
    return rounded(pooled.select("vec_id", F.posexplode("pooled").alias("i", "value")), "value")


EMBED_WORDS, EMBED_DIM, EMBED_BUCKETS = 1000, 8, 50


def _fixed_vector() -> Column:
    return F.array(*[((F.col("token_id") * (i + 7)) % 101) / F.lit(101.0) for i in range(EMBED_DIM)])


@query(f"""WITH words AS (
  SELECT doc_id AS id, unnest({fx.WORDS_SQL.format(text='text')}) AS token FROM documents),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (
    SELECT token, count(*) AS n FROM words GROUP BY token ORDER BY n DESC, token LIMIT {EMBED_WORDS})),
known AS (
  SELECT id, coalesce(token_id, 100000 + CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {EMBED_BUCKETS}) AS token_id, count(*) AS n
  FROM words LEFT JOIN vocabulary USING (token) GROUP BY ALL),
pooled AS (
  SELECT id, i, sum(n * (token_id * (i + 7) % 101) / 101.0::DOUBLE) / sum(n) AS value
  FROM known, (SELECT unnest(range({EMBED_DIM})) AS i) GROUP BY id, i)
SELECT d.doc_id AS id, d.i::INT AS i, round(COALESCE(p.value, 0.0::DOUBLE), 6) AS value
FROM (SELECT doc_id, unnest(range({EMBED_DIM})) AS i FROM documents) d LEFT JOIN pooled p ON p.id = d.doc_id AND p.i = d.i""")
def embed_text_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the mean of given word vectors; words without one share the vectors of buckets."""
    docs = fx.level_docs(spark, sf_dir)
    own = learn_vocabulary(docs, EMBED_WORDS).select("token", "token_id")
    shared = spark.range(EMBED_BUCKETS).select(
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("token"), (F.col("id") + 100_000).cast("int").alias("token_id"))
    vectors = own.union(shared).select("token", _fixed_vector().alias("vector"))
    pooled = pooling.embed_text(docs, vectors, EMBED_DIM, buckets=EMBED_BUCKETS)
    return rounded(pooled.select("id", F.posexplode("pooled").alias("i", "value")), "value")


# --- evaluation --------------------------------------------------------------

@query(f"""WITH {fx.PRED_SQL} SELECT count(*) AS n, sum((y = p)::INT)::BIGINT AS correct,
round(avg((y = p)::INT), 6) AS accuracy FROM level_pred""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(_cells(spark, sf_dir)), "accuracy")


@query(f"WITH {fx.STATS_SQL} SELECT round(avg(f1), 6) AS macro_f1 FROM perf WHERE support + predicted > 0")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged over the labels that occur."""
    return rounded(metrics.macro_f1(_cells(spark, sf_dir)), "macro_f1")


@query(f"WITH {fx.STATS_SQL} SELECT round(avg(f1), 6) AS macro_f1 FROM perf")
def macro_f1_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro_f1(_cells(spark, sf_dir), present_only=False), "macro_f1")


REPORT_SQL = """report AS (
  SELECT label_id AS position, code AS name, prec AS precision, rec AS recall, f1, support FROM perf
  UNION ALL SELECT 6, 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support)::BIGINT FROM perf
  UNION ALL SELECT 7, 'macro avg', avg(prec), avg(rec), avg(f1), sum(support)::BIGINT FROM perf
  UNION ALL SELECT 8, 'weighted avg', sum(prec * support) / sum(support), sum(rec * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::BIGINT FROM perf)"""


@query(f"""WITH {fx.STATS_SQL}, {REPORT_SQL}
SELECT position, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM report""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(_cells(spark, sf_dir)), "precision", "recall", "f1")


MATRIX_SQL = """matrix AS (
  SELECT t.label_id AS true_id, q.label_id AS pred_id, COALESCE(c.n, 0) AS n
  FROM levels t CROSS JOIN levels q LEFT JOIN cells c ON c.y = t.label_id AND c.p = q.label_id)"""


@query(f"WITH {fx.CELLS_SQL}, {MATRIX_SQL} SELECT true_id, pred_id, n FROM matrix")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_cells(spark, sf_dir))


_WIDE = ", ".join(
    f"COALESCE(sum(n) FILTER (pred_id = {i}), 0)::BIGINT AS {level}" for i, level in enumerate(LEVELS))


@query(f"""WITH {fx.CELLS_SQL}, {MATRIX_SQL}
SELECT ['A1','A2','B1','B2','C1','C2'][true_id + 1] AS true_level, {_WIDE} FROM matrix GROUP BY true_id""")
def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as displayed."""
    return metrics.confusion_wide(_cells(spark, sf_dir))


@query(f"""WITH {fx.STATS_SQL}
SELECT s.label_id, s.code AS level, round((SELECT avg((p = y)::INT) FROM level_pred WHERE y = s.label_id), 6) AS class_accuracy,
       round(prec, 6) AS precision, round(rec, 6) AS recall, support FROM perf s WHERE support > 0""")
def per_class_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class_perf(_cells(spark, sf_dir)), "class_accuracy", "precision", "recall")


SIDES_SQL = """sides AS (
  SELECT 'overall' AS side, confidence FROM level_pred
  UNION ALL SELECT CASE WHEN p = y THEN 'correct' ELSE 'incorrect' END, confidence FROM level_pred)"""

_SIDE_COLUMNS = ", ".join(
    f"count(*) FILTER (side = '{s}') AS n_{s}, round(avg(confidence) FILTER (side = '{s}'), 6) AS mean_{s}, "
    f"round(stddev_pop(confidence) FILTER (side = '{s}'), 6) AS std_{s}" for s in ("overall", "correct", "incorrect"))


@query(f"WITH {fx.PRED_SQL}, {SIDES_SQL} SELECT {_SIDE_COLUMNS} FROM sides")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.confidence_stats(fx.level_pred(spark, sf_dir))
    return rounded(stats, *[c for c in stats.columns if not c.startswith("n_")])


BANDS_SQL = """bands AS (
  SELECT band, count(confidence) AS n, round(100 * count(confidence)::DOUBLE / (SELECT count(*) FROM level_pred), 1) AS pct
  FROM (VALUES ('high', 0.8, 2.0), ('medium', 0.6, 0.8), ('low', -1.0, 0.6)) b(band, lo, hi)
  LEFT JOIN level_pred ON confidence > lo::DOUBLE AND confidence <= hi::DOUBLE GROUP BY band)"""


@query(f"WITH {fx.PRED_SQL}, {BANDS_SQL} SELECT band, n, pct FROM bands")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confidence_buckets(fx.level_pred(spark, sf_dir))


@query(f"WITH {fx.PRED_SQL} SELECT count(*) AS n_errors FROM level_pred WHERE p <> y")
def error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_count(_cells(spark, sf_dir))


@query(f"""WITH {fx.STATS_SQL}
SELECT label_id, code AS level, support AS n_true, predicted AS n_pred, predicted - support AS diff,
       CASE WHEN predicted > support THEN '+' ELSE '' END || CAST(predicted - support AS VARCHAR) AS diff_text FROM perf""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_distribution(_cells(spark, sf_dir))


@query(f"""WITH {fx.STATS_SQL}
SELECT sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1 FROM perf""")
def evaluate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.evaluate_table(_cells(spark, sf_dir)), "accuracy", "macro_f1")


@query(f"""WITH {fx.PRED_SQL}
SELECT id, ['A1','A2','B1','B2','C1','C2'][y + 1] AS true_level, ['A1','A2','B1','B2','C1','C2'][p + 1] AS predicted_level,
       CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
FROM level_pred WHERE p <> y ORDER BY id LIMIT 10""")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.top_errors(fx.level_pred(spark, sf_dir))


# --- candidate selection -----------------------------------------------------

_CANDIDATES = ", ".join(f"({c})" for c in fx.CANDIDATES)
_GUESS = " + ".join(f"CAST(n_words * candidate >= {edge} AS INT)" for edge in fx.LENGTH_EDGES)
HISTORY_SQL = f"""{fx.DOCS_SQL}, guesses AS (
  SELECT candidate, y, {_GUESS} AS p
  FROM (SELECT y, len(string_split(text, ' ')) AS n_words FROM level_docs), (VALUES {_CANDIDATES}) c(candidate)),
labels_seen AS (
  SELECT candidate, l, sum(t)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(q)::BIGINT AS predicted FROM (
    SELECT candidate, y AS l, (y = p)::INT AS t, 1 AS s, 0 AS q FROM guesses
    UNION ALL SELECT candidate, p, 0, 0, 1 FROM guesses) GROUP BY candidate, l),
history AS (
  SELECT candidate, sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS accuracy,
         avg((2 * tp)::DOUBLE / (support + predicted)) AS macro_f1 FROM labels_seen GROUP BY candidate)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guess the level from the word count, once per assumed word length."""
    docs = fx.level_docs(spark, sf_dir).select("y", F.size(F.split("text", " ")).alias("n_words"))
    tried = docs.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in fx.CANDIDATES])))
    guesses = tried.withColumn("p", fx.length_level(F.col("n_words") * F.col("candidate")))
    cells = metrics.confusion_cells(guesses, by=("candidate",))
    return metrics.evaluate_table(cells, by=("candidate",))


@query(f"""WITH {HISTORY_SQL}, tracked AS (
  SELECT *, COALESCE(max(macro_f1) OVER (ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before
  FROM history)
SELECT candidate, round(macro_f1, 6) AS macro_f1, round(best_before, 6) AS best_before, macro_f1 > best_before AS is_best
FROM tracked""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = selection.running_best(_history(spark, sf_dir))
    return rounded(tracked.select("candidate", "macro_f1", "best_before", "is_best"), "macro_f1", "best_before")


@query(f"""WITH {HISTORY_SQL}
SELECT candidate, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM history
WHERE macro_f1 > 0 ORDER BY history.macro_f1 DESC, candidate LIMIT 1""")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.select_best(_history(spark, sf_dir)), "accuracy", "macro_f1")


# --- report ------------------------------------------------------------------

def _unpivot(section: str, item: str, source: str, measures: tuple[str, ...]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{m.split(' AS ')[-1]}' AS measure, "
        f"CAST({m.split(' AS ')[0]} AS DOUBLE) AS value FROM {source}" for m in measures)


_REPORT_PARTS = "\nUNION ALL ".join((
    _unpivot("overall", "'all'", "perf", (
        "sum(support) AS n", "sum(tp)::DOUBLE / sum(support) AS accuracy",
        "avg(f1) FILTER (support + predicted > 0) AS macro_f1")),
    _unpivot("classification_report", "name", "report", ("precision", "recall", "f1", "support")),
    _unpivot("confusion_matrix", "true_id || '-' || pred_id", "matrix", ("n",)),
    _unpivot("per_class_perf", "code", "perf WHERE support > 0", (
        "rec AS class_accuracy", "prec AS precision", "rec AS recall")),
    _unpivot("confidence_stats", "side", "side_stats", ("n", "mean", "std")),
    _unpivot("confidence_buckets", "band", "bands", ("n", "pct")),
    _unpivot("error_count", "'all'", "level_pred WHERE p <> y", ("count(*) AS n_errors",)),
    _unpivot("class_distribution", "code", "perf", (
        "support AS n_true", "predicted AS n_pred", "predicted - support AS diff")),
))


@query(f"""WITH {fx.STATS_SQL}, {REPORT_SQL}, {MATRIX_SQL}, {SIDES_SQL}, {BANDS_SQL}, side_stats AS (
  SELECT side, count(*) AS n, avg(confidence) AS mean, stddev_pop(confidence) AS std FROM sides GROUP BY side),
parts AS ({_REPORT_PARTS})
SELECT section, item, measure, round(value, 6) AS value FROM parts""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric part of the report, from one pass over the predictions."""
    return rounded(rp.report_rows(rp.evaluation_report(fx.level_pred(spark, sf_dir))), "value")
