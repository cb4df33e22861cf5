"""The operators that are to stay native run no Python on the executors, and none joins all with all."""

import re

import pytest

from levelwise.llm.queries import QUERIES
from levelwise.llm import decontaminate, line_dedup


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_benchmark_decontamination", "op9_line_dedup"])
def test_native_operators(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"Python|MapInArrow|MapInPandas|Arrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tokens_are_searched_in_one_pass_without_a_shuffle(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    windows = decontaminate.windows(items)
    counts = windows.selectExpr("explode(terms) w").selectExpr("xxhash64(w) h").distinct().selectExpr("h", "1L n")
    found = plan_of(decontaminate.postings(docs, decontaminate.lookups(windows, counts), 1))
    top = found[: found.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in top and "Generate posexplode" in found


def test_line_hashes_are_combined_before_the_range_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(line_dedup.shared_lines(line_dedup.key_hashes(docs, 10)))
    assert plan.index("rangepartitioning") < plan.index("partial_")
    assert "text" not in plan[: plan.index("rangepartitioning")]
