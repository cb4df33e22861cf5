"""Fitting a class-weighted text classifier and choosing the best candidate."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS
from levelwise.functions.scoring import argmax_label
from levelwise.functions.text import WORD, words
from levelwise.operators.encode import MAX_VOCABULARY, learn_vocabulary, word_place
from levelwise.operators.metrics import LOSS_FLOOR, evaluate_table
from levelwise.operators.pair_vectors import learn_vectors
from levelwise.operators.pooling import mean_vectors
from levelwise.operators.selection import select_best
from levelwise.operators.weights import ALPHA, attach_class_weight, class_weights
from levelwise.sources.staging import staged

HISTORY_SCHEMA = (
    "candidate int, loss double, train_accuracy double, train_macro_f1 double, "
    "accuracy double, macro_f1 double"
)

CELL_SCHEMA = "candidate int, part string, y int, p int, n long, loss double, weight double"
SETTINGS_SCHEMA = (
    "version string, levels array<string>, num_features int, alpha double, use_class_weights boolean, "
    "aggregation_depth int, features string, dim int, candidates string, best int, history array<array<double>>, spark_version string, saved long"
)
VECTOR_BUCKETS, VECTOR_SEED = 64, 42


class NoUsefulCandidate(RuntimeError):
    """No candidate scored above zero on the validation rows."""


class ModelNotReady(RuntimeError):
    """There is no fitted model where one was expected."""


@dataclass(frozen=True)
class FitSettings:
    """How to fit. ``candidates`` are parameter sets tried in order.

    ``features`` is ``counts`` (TF-IDF of hashed words) or ``embedding`` (mean of
    ``dim`` components of vectors learned for hashed words). Both give every word
    one of ``num_features`` buckets, so no word is lost and a model has a known size.
    """

    candidates: tuple[dict, ...] = ({"regParam": 0.01, "maxIter": 10},)
    num_features: int = 4096
    alpha: float = ALPHA
    use_class_weights: bool = True
    levels: tuple[str, ...] = LEVELS
    aggregation_depth: int = 2
    features: str = "counts"
    dim: int = 64

    def __post_init__(self):
        if self.features not in ("counts", "embedding"):
            raise ValueError(f"features must be 'counts' or 'embedding', got {self.features!r}")


@dataclass(frozen=True)
class FittedClassifier:
    model: PipelineModel
    settings: FitSettings
    best: int
    history: tuple[tuple, ...] = field(default=())

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.history), HISTORY_SCHEMA).coalesce(1)


def fit_classifier(train: DataFrame, val: DataFrame, settings: FitSettings = FitSettings()) -> FittedClassifier:
    """Fit every candidate on ``train``, keep the best by validation macro F1.

    Both frames have ``text`` and ``label_id``. Two frames are two scans; parts
    of one table are better passed to :func:`fit_parts`.
    """
    both = train.select("text", "label_id", F.lit("train").alias("split")).unionByName(
        val.select("text", "label_id", F.lit("val").alias("split"))
    )
    return fit_parts(both, settings)


def fit_parts(parts: DataFrame, settings: FitSettings = FitSettings(), resume: str | None = None) -> FittedClassifier:
    """The same on one frame ``text, label_id, split``; other values of ``split`` are left out.

    ``resume`` names a folder that keeps finished candidates, so that a fit that
    was stopped goes on after the last of them (:class:`FitLog`).
    """
    with staged(word_counts(parts.where(F.col("split").isin("train", "val")), settings), "counts") as counted:
        return fit_counted(counted, settings, FitLog.of(resume, counted, settings) if resume else None)


class FitLog:
    """Commit log of a fit: the feature step and every finished candidate with its cells.

    Entries belong to one set of rows and settings; a fit on others finds none
    of them. A part is written into a fresh folder first; the row that names it
    is appended last, so a crash in between leaves the part undone. Numbers of
    candidates are not part of the key: adding candidates at the end of a list
    reuses those before it.
    """

    ENTRY = "name string, params string, version string, cells string, saved long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def of(cls, folder: str, counted: DataFrame, settings: FitSettings) -> FitLog:
        rows = F.xxhash64("part", "label_id", "weight", "counts").cast("decimal(38,0)")
        n, total = counted.agg(F.count(F.lit(1)), F.sum(rows)).first()
        own = [n, str(total), settings.num_features, settings.features, settings.dim, list(settings.levels), settings.aggregation_depth]
        return cls(counted.sparkSession, f"{folder}/fit-{hashlib.sha256(json.dumps(own).encode()).hexdigest()[:24]}")

    def get(self, name: str, params: dict) -> tuple[Transformer, list[tuple]] | None:
        """A finished part and its cells."""
        try:
            rows = self.spark.read.schema(self.ENTRY).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        done = rows.where((F.col("name") == name) & (F.col("params") == json.dumps(params, sort_keys=True))).orderBy(F.desc("saved")).first()
        if done is None:
            return None
        return PipelineModel.load(f"{self.path}/{done['version']}").stages[0], [tuple(cell) for cell in json.loads(done["cells"])]

    def put(self, name: str, params: dict, part: Transformer, cells: list[tuple] = ()) -> None:
        version = f"{name}-{uuid.uuid4().hex}"
        PipelineModel([part]).write().save(f"{self.path}/{version}")
        row = (name, json.dumps(params, sort_keys=True), version, json.dumps([list(cell) for cell in cells]), time.time_ns())
        self.spark.createDataFrame([row], self.ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/log")


def counting_stages(settings: FitSettings) -> PipelineModel:
    """Text to ``counts``: a sparse vector, or the buckets of the words in order for ``features="embedding"``."""
    tokenizer = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False, toLowercase=True)
    if settings.features == "embedding":
        named = f"transform(words, w -> CAST(pmod(xxhash64(w), {settings.num_features}) AS STRING))"
        return PipelineModel([tokenizer, SQLTransformer(statement=f"SELECT *, {named} AS counts FROM __THIS__")])
    return PipelineModel([tokenizer, HashingTF(inputCol="words", outputCol="counts", numFeatures=settings.num_features)])


def fit_features(train: DataFrame, settings: FitSettings) -> Transformer:
    """The step from ``counts`` to ``features``; the mean of a text's vectors is taken inside its row."""
    if settings.features == "counts":
        return IDF(inputCol="counts", outputCol="features").fit(train)
    found, vectors = learn_vectors(train, "counts", settings.num_features, settings.dim, int, VECTOR_SEED)
    return MeanVectors(inputCol="counts", outputCol="features").setVectors(settings.num_features, found, vectors)


class MeanVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of the vectors of a text's buckets, taken inside its row; a bucket never seen counts as zeros."""

    vectors = Param(Params._dummy(), "vectors", "a vector for each bucket", TypeConverters.identity)

    @keyword_only
    def __init__(self, inputCol: str = "counts", outputCol: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def setVectors(self, size: int, found: Sequence[int], vectors: np.ndarray) -> MeanVectors:
        kept = np.zeros((size, vectors.shape[1]))
        kept[list(found)] = vectors[list(found)]
        return self._set(vectors=kept.tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = np.array(self.getOrDefault(self.vectors))
        # No bucket has the last place, which is that of unknown words: all words count.
        matrix = np.concatenate((matrix, np.zeros((1, matrix.shape[1]))))

        @F.arrow_udf("array<double>")
        def mean(lists: pa.Array) -> pa.Array:
            return mean_vectors(lists, int, matrix)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mean(self.getInputCol())))


def word_counts(parts: DataFrame, settings: FitSettings, keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """``part, label_id, weight, counts``: the one pass over the text, whole texts, no shuffle.

    Training rows weigh what their class weighs, others one. The weights come
    from the labels alone.
    """
    in_train = F.col("split") == "train"
    weights = class_weights(parts.where(in_train), "label_id", settings.levels, settings.alpha)
    if not settings.use_class_weights:
        weights = weights.withColumn("weight", F.lit(1.0))
    weighted = attach_class_weight(parts.select("text", "label_id", "split", *keep), weights)
    kept = [c for c in weighted.columns if c not in ("text", "label_id", "split", "weight")]
    weight = F.when(in_train, F.col("weight")).otherwise(1.0)
    return counting_stages(settings).transform(weighted).select(
        F.col("split").alias("part"), "label_id", weight.alias("weight"), "counts", *kept)


def fit_counted(counted: DataFrame, settings: FitSettings, log: FitLog | None = None) -> FittedClassifier:
    """Fit on staged word counts: each candidate only iterates over the vectors and is judged by one aggregation.

    What ``log`` holds is not fitted again.

    The driver holds coefficients (``levels x num_features``), bucket
    vectors (``num_features x dim``) and cell counts, never rows.
    """
    spark = counted.sparkSession
    models, cells = [], []
    used = counted.where(F.col("part").isin("train", "val"))
    in_train = F.col("part") == "train"
    done = log.get("features", {}) if log else None
    to_features = done[0] if done else fit_features(used.where(in_train), settings)
    if log and not done:
        log.put("features", {}, to_features)
    rows = to_features.transform(used)
    for number, params in enumerate(settings.candidates, start=1):
        done = log.get("candidate", params) if log else None
        if done:
            model, own = done
        else:
            model = LogisticRegression(
                featuresCol="features", labelCol="label_id", weightCol="weight", family="multinomial",
                aggregationDepth=settings.aggregation_depth, **params,
            ).fit(rows.where(in_train))
            own = _scored_cells(model, rows)
            if log:
                log.put("candidate", params, model, own)
        models.append(model)
        cells += [(number, *cell) for cell in own]

    history = _history(spark, cells)
    chosen = select_best(spark.createDataFrame(history, HISTORY_SCHEMA).coalesce(1)).first()
    if chosen is None:
        raise NoUsefulCandidate("no candidate scored a macro F1 above zero on the validation rows")
    best = chosen["candidate"]
    fitted = PipelineModel([*counting_stages(settings).stages, to_features, models[best - 1]])
    return FittedClassifier(fitted, settings, best, history)


def score_counted(fitted: FittedClassifier, counted: DataFrame) -> DataFrame:
    """``counted`` with ``probability``: the model without the steps that read text."""
    return PipelineModel(fitted.model.stages[2:]).transform(counted).withColumn("probability", vector_to_array("probability"))


def _scored_cells(model, rows: DataFrame) -> list[tuple]:
    """Confusion cells of both parts with their weighted loss, in one pass.

    At most ``2 x levels x levels`` rows come back.
    """
    scored = model.transform(rows).withColumn("prob", vector_to_array("probability"))
    loss = -F.log(F.greatest(F.get("prob", F.col("label_id")), F.lit(LOSS_FLOOR)))
    cells = scored.groupBy("part", F.col("label_id").alias("y"), argmax_label("prob").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * loss).alias("loss"), F.sum("weight").alias("weight")
    )
    return [tuple(cell) for cell in cells.collect()]


def _history(spark: SparkSession, cells: list[tuple]) -> tuple[tuple, ...]:
    """One row per candidate: training loss, then accuracy and F1 of both parts."""
    table = spark.createDataFrame(cells, CELL_SCHEMA).coalesce(1)
    measured = {
        (row["candidate"], row["part"]): (row["accuracy"], row["macro_f1"])
        for row in evaluate_table(table, by=("candidate", "part")).collect()
    }
    train_cells = [cell for cell in cells if cell[1] == "train"]
    losses = {}
    for candidate in sorted({cell[0] for cell in train_cells}):
        own = [cell for cell in train_cells if cell[0] == candidate]
        losses[candidate] = sum(cell[5] for cell in own) / sum(cell[6] for cell in own)
    return tuple(
        (c, loss, *measured[c, "train"], *measured.get((c, "val"), (None, None))) for c, loss in losses.items()
    )


def save_classifier(fitted: FittedClassifier, path: str) -> None:
    """Write the pipeline into a fresh folder below ``path``, then one row of settings that names it.

    Until that row is replaced, readers load the old pipeline. Old versions stay.
    """
    spark = SparkSession.active()
    version = f"pipeline-{uuid.uuid4().hex}"
    fitted.model.write().save(f"{path}/{version}")
    s = fitted.settings
    row = (
        version, list(s.levels), s.num_features, s.alpha, s.use_class_weights, s.aggregation_depth, s.features, s.dim,
        json.dumps(list(s.candidates)), fitted.best, [list(map(float, h)) for h in fitted.history], spark.version,
        time.time_ns(),
    )
    # Appended last, in one file: its presence marks a complete artefact, the newest one counts.
    spark.createDataFrame([row], SETTINGS_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/settings")


def load_classifier(spark: SparkSession, path: str, levels: Sequence[str] | None = None) -> FittedClassifier:
    """Read the newest saved classifier with all its settings; checks the level list if given."""
    try:
        row = spark.read.schema(SETTINGS_SCHEMA).json(f"{path}/settings").orderBy(F.desc("saved")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ModelNotReady(f"no fitted model at {path}") from error
        raise
    if row is None:
        raise ModelNotReady(f"incomplete model at {path}")
    if levels is not None and list(levels) != row["levels"]:
        raise ValueError(f"model at {path} was fitted for levels {row['levels']}, not {list(levels)}")
    settings = FitSettings(
        candidates=tuple(json.loads(row["candidates"])),
        num_features=row["num_features"],
        alpha=row["alpha"],
        use_class_weights=row["use_class_weights"],
        levels=tuple(row["levels"]),
        aggregation_depth=row["aggregation_depth"],
        # Models saved before there was a choice have neither.
        features=row["features"] or "counts",
        dim=row["dim"] or FitSettings.dim,
    )
    history = tuple((int(h[0]), *h[1:]) for h in row["history"])
    return FittedClassifier(PipelineModel.load(f"{path}/{row['version']}"), settings, row["best"], history)


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], FittedClassifier]) -> FittedClassifier:
    """The saved classifier, or a new one that is fitted and saved first."""
    try:
        return load_classifier(spark, path)
    except ModelNotReady:
        fitted = fit()
        save_classifier(fitted, path)
        return fitted


def learn_token_vectors(
    df: DataFrame, vocabulary_size: int, dim: int, text: str = "text", seed: int = VECTOR_SEED, partitions: int | None = None,
    buckets: int = VECTOR_BUCKETS,
) -> DataFrame:
    """``(token, vector)`` learned from the corpus for its most frequent words and for buckets of all other words.

    Exactly the first ``vocabulary_size`` words of :func:`learn_vocabulary` have
    a vector of their own; every other word is read as its bucket, so no word is
    lost. They are trained on exact counts of near words (:func:`learn_vectors`);
    ``partitions`` cuts the table of pairs, by default by their number.
    """
    if not 0 < vocabulary_size <= MAX_VOCABULARY:
        raise ValueError(f"vocabulary size must be between 1 and {MAX_VOCABULARY}, got {vocabulary_size}")
    known = [row["token"] for row in learn_vocabulary(df, vocabulary_size, text).orderBy("token_id").collect()]
    names = [*known, *(f"#{b}" for b in range(buckets))]
    places = {name: i for i, name in enumerate(names)}
    sent = df.sparkSession.sparkContext.broadcast(places)
    found, vectors = learn_vectors(
        df.select(words(text).alias("words")), "words", len(names), dim, lambda word: word_place(sent.value, word, buckets), seed, partitions)
    return df.sparkSession.createDataFrame([(names[i], vectors[i].tolist()) for i in found], "token string, vector array<double>")
