"""Shape of the physical plans that matter at scale."""

import re

import pytest

from levelwise.catalog import aggregates, checks, models, rows, streams  # noqa: F401  (they register the queries)
from levelwise.catalog.registry import ORACLES, QUERIES

NARROW = ("encode_corpus", "encode_pieces", "embed_text_fixed", "score_encoded", "score_requests", "clean_text", "text_preview", "request_status", "label_to_id", "softmax", "score_linear")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


FITTED = ("score_table", "embed_text", "train_and_evaluate")


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.endswith("_facts")) + list(FITTED))
def test_no_python_workers(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NARROW)
def test_row_work_needs_no_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["stratified_split", "classification_report", "confidence_stats", "class_weights"])
def test_text_is_not_read_when_not_needed(spark, sf_dir, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf_dir)))
    assert schemas and all("text" not in s for s in schemas)


def test_split_assigns_rows_without_moving_them(spark, sf_dir):
    plan = plan_of(QUERIES["stratified_split"](spark, sf_dir))
    top = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in top and "BroadcastHashJoin" in top


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for name in ("confusion_matrix", "class_weights", "mean_pool"):
        assert "partial_" in plan_of(QUERIES[name](spark, sf_dir))


def test_top_errors_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_errors"](spark, sf_dir))


def test_heads_have_no_lambdas(spark, sf_dir):
    for name in ("score_encoded", "score_requests"):
        assert not re.search(r"zip_with|aggregate\(", plan_of(QUERIES[name](spark, sf_dir)))


def test_pooling_has_one_state_for_any_width(spark):
    from levelwise.operators.pooling import mean_pool

    rows = spark.createDataFrame([(0, [1.0] * 768)], "id int, vec array<double>")
    plan = plan_of(mean_pool(rows, 768))
    assert plan.count("sum(") <= 8 and "partial_aggregate_metrics" in plan
