import random

import numpy as np
import pytest

from levelwise.functions.labels import LEVELS
from levelwise.operators import errors, metrics, selection
from levelwise.plans.report import evaluation_report, report_rows


def brute(pairs):
    """Per-class and averaged metrics straight from their definitions."""
    per_class = []
    for c in range(6):
        tp = sum(y == p == c for y, p in pairs)
        support = sum(y == c for y, _ in pairs)
        predicted = sum(p == c for _, p in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        per_class.append((precision, recall, f1, support, predicted))
    seen = [c for c in range(6) if per_class[c][3] + per_class[c][4]]
    n = len(pairs)
    return {
        "classes": per_class,
        "accuracy": sum(y == p for y, p in pairs) / n,
        "macro_present": sum(per_class[c][2] for c in seen) / len(seen),
        "macro_all": [sum(c[k] for c in per_class) / 6 for k in range(3)],
        "weighted": [sum(c[k] * c[3] for c in per_class) / n for k in range(3)],
    }


GOLDEN = [(0, 0), (0, 1), (1, 1), (2, 1)]


def test_golden_values(scored):
    cells = metrics.confusion_cells(scored(*GOLDEN))
    assert metrics.accuracy(cells).first()["accuracy"] == 0.5
    assert metrics.macro_f1(cells).first()[0] == pytest.approx(0.388889, abs=1e-6)
    assert metrics.macro_f1(cells, present_only=False).first()[0] == pytest.approx(0.194444, abs=1e-6)
    report = {r["name"]: r for r in metrics.classification_report(cells).collect()}
    assert report["weighted avg"]["f1"] == pytest.approx(0.458333, abs=1e-6)
    assert report["macro avg"]["f1"] == pytest.approx(0.194444, abs=1e-6)
    assert [report[c]["f1"] for c in ("A1", "A2", "B1")] == pytest.approx([2 / 3, 0.5, 0.0])


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(scored, seed):
    rng = random.Random(seed)
    classes = rng.sample(range(6), rng.randint(2, 6))
    pairs = [(rng.choice(classes), rng.choice(range(6)) if rng.random() < 0.4 else rng.choice(classes)) for _ in range(120)]
    expected = brute(pairs)
    cells = metrics.confusion_cells(scored(*pairs))
    row = metrics.evaluate_table(cells).first()
    assert row["n"] == 120
    assert row["accuracy"] == pytest.approx(expected["accuracy"])
    assert row["macro_f1"] == pytest.approx(expected["macro_present"])
    report = metrics.classification_report(cells).collect()
    assert [r["name"] for r in report] == [*LEVELS, "accuracy", "macro avg", "weighted avg"]
    for c, line in enumerate(report[:6]):
        assert (line["precision"], line["recall"], line["f1"], line["support"]) == pytest.approx(expected["classes"][c][:4])
    assert report[6]["precision"] is None and report[6]["f1"] == pytest.approx(expected["accuracy"])
    assert [report[7][k] for k in ("precision", "recall", "f1")] == pytest.approx(expected["macro_all"])
    assert [report[8][k] for k in ("precision", "recall", "f1")] == pytest.approx(expected["weighted"])
    matrix = metrics.confusion_matrix(cells).collect()
    assert len(matrix) == 36 and sum(r["n"] for r in matrix) == 120
    assert all(r["n"] == pairs.count((r["true_id"], r["pred_id"])) for r in matrix)
    perf = {r["label_id"]: r for r in metrics.per_class_perf(cells).collect()}
    assert set(perf) == {y for y, _ in pairs}
    for c, r in perf.items():
        inside = [p == c for y, p in pairs if y == c]
        assert r["class_accuracy"] == r["recall"] == pytest.approx(sum(inside) / len(inside))
    shown = metrics.class_distribution(cells).collect()
    assert [r["n_true"] for r in shown] == [sum(y == c for y, _ in pairs) for c in range(6)]
    assert [r["diff"] for r in shown] == [r["n_pred"] - r["n_true"] for r in shown]


def test_metrics_by_group_match_single_runs(spark, scored):
    from pyspark.sql import functions as F

    rows = scored(*[(i % 3, (i * 7) % 4) for i in range(40)]).withColumn("g", F.col("id") % 2)
    grouped = {r["g"]: r for r in metrics.evaluate_table(metrics.confusion_cells(rows, by=("g",)), by=("g",)).collect()}
    for g in (0, 1):
        single = metrics.evaluate_table(metrics.confusion_cells(rows.where(F.col("g") == g))).first()
        assert (grouped[g]["n"], grouped[g]["accuracy"], grouped[g]["macro_f1"]) == pytest.approx(tuple(single))


def test_empty_table(scored):
    empty = scored((0, 0)).where("id < 0")
    cells = metrics.confusion_cells(empty)
    assert tuple(metrics.evaluate_table(cells).first()) == (0, None, None)
    assert tuple(metrics.accuracy(cells).first()) == (0, 0, None)
    assert metrics.macro_f1(cells).first()[0] is None
    assert metrics.error_count(cells).first()[0] == 0
    assert all(v in (0, None) for v in metrics.confidence_stats(empty).first())
    assert sum(r["n"] for r in metrics.confusion_matrix(cells).collect()) == 0
    assert [(r["n"], r["pct"]) for r in metrics.confidence_buckets(empty).collect()] == [(0, None)] * 3


def test_all_correct_has_null_incorrect_side(scored):
    row = metrics.confidence_stats(scored((0, 0, 0.5), (1, 1, 0.7))).first()
    assert row["mean_incorrect"] is None and row["std_incorrect"] is None
    assert row["std_overall"] == pytest.approx(np.std([0.5, 0.7]))


def test_buckets_edges(scored):
    rows = scored(*[(0, 0, c) for c in (0.8, 0.6, 0.81, 0.61, 0.1)])
    got = {r["band"]: (r["n"], r["pct"]) for r in metrics.confidence_buckets(rows).collect()}
    assert got == {"high": (1, 20.0), "medium": (2, 40.0), "low": (2, 40.0)}


def test_log_loss(spark):
    rows = spark.createDataFrame([(0.5, 2.0), (0.25, 1.0), (0.0, 1.0)], "p_true double, weight double")
    expected = (2 * -np.log(0.5) - np.log(0.25) - np.log(1e-15)) / 4
    assert metrics.weighted_log_loss(rows).first()[0] == pytest.approx(expected)


def test_top_errors_keep_id_order(scored):
    rows = scored(*[(i % 6, (i + i % 2) % 6) for i in range(60)])
    got = errors.top_errors(rows.repartition(5)).collect()
    assert [r["id"] for r in got] == list(range(1, 20, 2))
    assert got[0]["true_level"] == "A2" and got[0]["predicted_level"] == "B1"
    assert errors.misclassified(rows).count() == 30


def test_align_predictions(spark, scored):
    rows = scored((0, 0), (1, 2))
    joined = errors.align_predictions(rows.select("id", "y"), rows.select("id", "p")).orderBy("id").collect()
    assert [r["correct"] for r in joined] == [True, False]


def test_selection(spark):
    def history(*scores):
        return spark.createDataFrame(list(enumerate(map(float, scores), 1)), "candidate int, macro_f1 double")

    assert selection.select_best(history(0.4, 0.6, 0.6)).first()["candidate"] == 2
    assert selection.select_best(history(0.0, 0.0)).collect() == []
    marks = selection.running_best(history(0.4, 0.3, 0.6, 0.6)).orderBy("candidate").collect()
    assert [r["is_best"] for r in marks] == [True, False, True, False]
    assert not selection.running_best(history(0.0)).first()["is_best"]


def test_report_equals_direct_metrics(scored):
    rng = random.Random(3)
    rows = scored(*[(rng.randrange(5), rng.randrange(6), rng.random()) for _ in range(200)])
    report = evaluation_report(rows)
    cells = metrics.confusion_cells(rows)
    direct = metrics.confidence_stats(rows).first()
    sides = {r["side"]: r for r in report["confidence_stats"].collect()}
    for side in ("overall", "correct", "incorrect"):
        assert sides[side]["n"] == direct[f"n_{side}"]
        assert sides[side]["mean"] == pytest.approx(direct[f"mean_{side}"])
        assert sides[side]["std"] == pytest.approx(direct[f"std_{side}"])
    assert sorted(map(tuple, report["confidence_buckets"].collect())) == sorted(
        map(tuple, metrics.confidence_buckets(rows).collect()))
    assert report["classification_report"].collect() == metrics.classification_report(cells).collect()
    assert report["top_errors"].collect() == errors.top_errors(rows).collect()
    assert report_rows(report).where("section = 'confusion_matrix'").count() == 36


def test_labels_outside_the_levels(spark, scored):
    rows = scored((0, 0), (1, None), (7, 0), (2, 2))
    with pytest.raises(Exception, match="label outside the levels: 1, NULL|label outside the levels: 7, 0"):
        metrics.confusion_cells(rows).collect()
    assert tuple(metrics.outside_count(rows).first()) == (4, 2)
    cells = metrics.confusion_cells(rows, outside="drop")
    assert metrics.evaluate_table(cells).first()["n"] == 2
    assert metrics.classification_report(cells).where("name = 'weighted avg'").first()["support"] == 2
    with pytest.raises(ValueError):
        metrics.confusion_cells(rows, outside="ignore")


def test_wide_matrix_keeps_the_order_of_levels(scored):
    wide = metrics.confusion_wide(metrics.confusion_cells(scored((0, 0), (2, 1)), levels=("low", "mid", "high")), ("low", "mid", "high"))
    assert [r["true_level"] for r in wide.collect()] == ["low", "mid", "high"]


def test_align_predictions_reports_unmatched_rows(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    predicted = spark.createDataFrame([(1, 0), (3, 1)], "id long, p int")
    rows = {r["id"]: (r["correct"], r["missing"]) for r in errors.align_predictions(truth, predicted).collect()}
    assert rows == {1: (True, None), 2: (False, "prediction"), 3: (False, "truth")}
