import math
import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from levelwise.catalog import fixtures as fx
from levelwise.functions.labels import LEVELS
from levelwise.operators.score import predict_text, score_table
from levelwise.operators.weights import attach_class_weight, class_weights
from levelwise.plans import fit as ft
from levelwise.plans.training import (
    DEMO_TEXTS, demo_predictions, evaluate_classifier, split_labelled, train_and_evaluate,
)

SETTINGS = ft.FitSettings(
    candidates=({"regParam": 0.5, "maxIter": 3}, {"regParam": 0.05, "maxIter": 60}), num_features=64)


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    return split_labelled(fx.labelled_docs(spark, sf_dir), settings=SETTINGS, allow_rare=True)


@pytest.fixture(scope="module")
def fitted(parts):
    return ft.fit_classifier(parts.where("split = 'train'"), parts.where("split = 'val'"), SETTINGS)


def test_history_and_choice(spark, parts, fitted):
    assert [h[0] for h in fitted.history] == [1, 2]
    val_f1 = [h[5] for h in fitted.history]
    assert fitted.best == (2 if val_f1[1] > val_f1[0] else 1)
    again = evaluate_classifier(fitted, parts.where("split = 'val'")).first()
    assert (again["accuracy"], again["macro_f1"]) == pytest.approx(fitted.history[fitted.best - 1][4:])
    assert fitted.history_table(spark).count() == 2


def test_history_loss_is_the_weighted_log_loss(parts, fitted):
    train = parts.where("split = 'train'")
    rows = attach_class_weight(train, class_weights(train))
    scored = score_table(fitted.model, rows, "text").select(
        "label_id", "weight", F.get("probability", F.col("label_id")).alias("p")).collect()
    expected = sum(-r["weight"] * math.log(max(r["p"], 1e-15)) for r in scored) / sum(r["weight"] for r in scored)
    assert fitted.history[fitted.best - 1][1] == pytest.approx(expected)


def test_fit_reaches_the_optimum_of_the_weighted_problem(parts):
    """The gradient of the weighted, ridge-penalised loss vanishes at the solution."""
    settings = ft.FitSettings(candidates=({"regParam": 0.05, "maxIter": 500, "tol": 1e-10},), num_features=16)
    train = parts.where("split = 'train'")
    model = ft.fit_classifier(train, parts.where("split = 'val'"), settings).model
    rows = attach_class_weight(train, class_weights(train))
    data = model.transform(rows).select("label_id", "weight", vector_to_array("features").alias("x")).collect()
    x = np.array([r["x"] for r in data])
    y, w = np.array([r["label_id"] for r in data]), np.array([r["weight"] for r in data])
    # The penalty applies to standardised coefficients (sample deviation of the weighted rows).
    mean = np.average(x, axis=0, weights=w)
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    lr = model.stages[-1]
    coef, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    logits = x @ coef.T + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    error = w[:, None] * (p - np.eye(len(bias))[y]) / w.sum()
    used = sd > 0
    gradient = (error.T @ x)[:, used] / sd[used] + 0.05 * (coef * sd)[:, used]
    assert np.abs(gradient).max() < 1e-3
    assert np.abs(error.sum(0)).max() < 1e-3


def test_scores(spark, sf_dir, fitted):
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    scored = score_table(fitted.model, docs)
    assert scored.columns == ["id", "sentence", "probability", "pred_id", "cefr", "confidence"]
    for r in scored.collect():
        assert sum(r["probability"]) == pytest.approx(1.0)
        assert r["confidence"] == max(r["probability"]) >= 1 / 6 - 1e-12
        assert r["cefr"] == LEVELS[r["pred_id"]]
    level, confidence = predict_text(spark, fitted.model, DEMO_TEXTS[0])
    demo = demo_predictions(spark, fitted).orderBy("pos").collect()
    assert [r["sentence"] for r in demo] == list(DEMO_TEXTS)
    assert (demo[0]["cefr"], demo[0]["confidence"]) == (level, confidence)
    assert score_table(fitted.model, docs.where("id < 0")).count() == 0


def test_save_load_fit_or_load(spark, sf_dir, fitted, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(ft.ModelNotReady, match="no fitted model"):
        ft.load_classifier(spark, path)
    assert ft.fit_or_load(spark, path, lambda: fitted) is fitted
    loaded = ft.fit_or_load(spark, path, lambda: pytest.fail("should have been loaded"))
    assert loaded.settings == fitted.settings and loaded.best == fitted.best and loaded.history == fitted.history
    docs = fx.level_docs(spark, sf_dir).select("id", F.col("text").alias("sentence"))
    a, b = (score_table(f.model, docs).select("id", "cefr", "confidence") for f in (fitted, loaded))
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError, match="fitted for levels"):
        ft.load_classifier(spark, path, ("0", "1"))


def test_an_interrupted_save_leaves_the_old_model(spark, fitted, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    ft.save_classifier(fitted, path)
    with monkeypatch.context() as broken:
        broken.setattr(ft.json, "dumps", lambda _: 1 / 0)  # after the pipeline, before the settings
        with pytest.raises(ZeroDivisionError):
            ft.save_classifier(fitted, path)
    assert ft.load_classifier(spark, path).best == fitted.best
    other = ft.FittedClassifier(fitted.model, ft.FitSettings(candidates=({"fitIntercept": True, "family": "auto", "maxIter": 3},)), 1, fitted.history)
    ft.save_classifier(other, path)
    assert ft.load_classifier(spark, path).settings == other.settings  # types included, newest wins


def test_training_reads_the_text_once(parts):
    plan = ft.word_counts(parts, SETTINGS, ("id",))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext\b", plan)) == 1


def test_no_useful_candidate(spark):
    train = spark.createDataFrame([("a a", 0), ("b b", 1)] * 5, "text string, label_id int")
    val = spark.createDataFrame([("a a", 1), ("b b", 0)], "text string, label_id int")
    with pytest.raises(ft.NoUsefulCandidate):
        ft.fit_classifier(train, val, ft.FitSettings(num_features=16, levels=("0", "1")))


def test_whole_job(spark, sf_dir):
    run = train_and_evaluate(fx.labelled_docs(spark, sf_dir), ft.FitSettings(num_features=64), allow_rare=True)
    sizes = {r["split"]: r["n"] for r in run.split_sizes.collect()}
    assert sizes == {"train": 140, "val": 30, "test": 30}
    assert run.scored_test.count() == run.report["overall"].first()["n"] == 30
    report = run.report["classification_report"].collect()
    assert len(report) == 9 and sum(r["support"] for r in report[:6]) == 30
    assert run.demo.count() == 4


def test_token_vectors(spark, sf_dir):
    docs = fx.level_docs(spark, sf_dir)
    vectors = ft.learn_token_vectors(docs, vocabulary_size=50, dim=4, partitions=2, buckets=4)
    rows = vectors.collect()
    buckets = [r["token"] for r in rows if r["token"].startswith("#")]
    assert len(rows) - len(buckets) == 50 and 0 < len(buckets) <= 4 and all(len(r["vector"]) == 4 for r in rows)


def test_token_vectors_when_all_counts_tie(spark):
    df = spark.createDataFrame([("a b c d",), ("e f g h",), ("",)], "text string")
    tokens = {r["token"] for r in ft.learn_token_vectors(df, vocabulary_size=3, dim=2, buckets=2).collect()}
    assert {"a", "b", "c"} <= tokens and tokens - {"a", "b", "c"} <= {"#0", "#1"}
    with pytest.raises(ValueError):
        ft.learn_token_vectors(df, vocabulary_size=ft.MAX_VOCABULARY + 1, dim=2)
    assert ft.learn_token_vectors(df, vocabulary_size=ft.MAX_VOCABULARY, dim=2).count() == 8


def test_classifier_on_pooled_vectors(spark, parts, tmp_path):
    settings = ft.FitSettings(features="embedding", dim=8, num_features=256)
    fitted = ft.fit_parts(parts, settings)
    rows = parts.select("id", "text").union(spark.createDataFrame([(-1, ""), (-2, "größer 2024")], "id long, text string"))
    scored = score_table(fitted.model, rows, "text")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    first = {r.id: r.probability for r in scored.select("id", "probability").collect()}
    ft.save_classifier(fitted, f"{tmp_path}/pooled")
    loaded = ft.load_classifier(spark, f"{tmp_path}/pooled")
    assert loaded.settings == settings
    assert {r.id: r.probability for r in score_table(loaded.model, rows, "text").collect()} == first
    # Vectors are learned and pooled: the text with no word has zeros, others do not.
    pooled = {r.id: r.features for r in fitted.model.transform(rows).collect()}
    assert not pooled[-1].toArray().any() and pooled[-2].toArray().any()


def test_unknown_features_are_refused():
    with pytest.raises(ValueError):
        ft.FitSettings(features="other")
