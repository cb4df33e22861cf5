"""Orders of epochs, bucketed tables, files that were split before."""

import re

import pytest
from pyspark.sql import functions as F

from levelwise.operators import permutation as pm
from levelwise.operators.errors import align_predictions, write_bucketed
from levelwise.plans import fit as ft, training as tr


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 100, 1009])
def test_every_epoch_is_a_bijection(spark, n):
    orders = [[r["place"] for r in pm.with_place(spark.range(0, n, 1, 1), n, e, "id").collect()] for e in range(4)]
    assert all(sorted(own) == list(range(n)) for own in orders)
    if n > 50:
        assert len(set(map(tuple, orders))) == 4
        # Neighbours do not stay neighbours.
        assert all(sum(abs(a - b) == 1 for a, b in zip(own, own[1:])) < n / 5 for own in orders)


def test_large_positions_do_not_overflow(spark):
    n = 2**40 - 87
    at = [0, 1, n // 2, n - 1, 12345678901]
    rows = pm.with_place(spark.createDataFrame([(p,) for p in at], "p long"), n, 3, "p", "q").collect()
    assert len({r["q"] for r in rows}) == len(at) and all(0 <= r["q"] < n for r in rows)
    with pytest.raises(ValueError):
        pm.with_place(spark.range(1), 2**40, 0, "id")


def test_positions_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pm, "BUCKET_ROWS", 40)
    ids = spark.range(0, 1000, 7)
    expected = {r["id"]: i for i, r in enumerate(ids.withColumn("k", pm.order_hash("id")).orderBy("k", "id").collect())}
    for parts in (1, 5, 16):
        placed, n = pm.hash_positions(ids.repartition(parts))
        assert n == 143 and {r["id"]: r["position"] for r in placed.collect()} == expected
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    parts = pm.shuffled_parts(placed, n, 1, 50)
    rows = parts.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["place"] for r in rows) == list(range(143)) and all(r["part"] == r["place"] // 50 for r in rows)
    for part in range(3):
        own = [r for r in rows if r["part"] == part]
        assert len({r["task"] for r in own}) == 1 and [r["place"] for r in own] == sorted(r["place"] for r in own)


def test_bucketed_tables_are_aligned_without_an_exchange(spark, tmp_path):
    truth = spark.createDataFrame([(i, i % 6) for i in range(0, 90)], "id long, y int")
    predicted = spark.createDataFrame([(i, i % 5) for i in range(10, 100)], "id long, p int")
    tables = [write_bucketed(df, f"t{i}_{tmp_path.name.replace('-', '_')}", str(tmp_path / str(i)), 4) for i, df in enumerate((truth, predicted))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = align_predictions(*tables)
        assert not re.search("Exchange", joined._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(str, joined.collect())) == sorted(map(str, align_predictions(truth, predicted).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_that_were_split_before(spark, tmp_path):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} text {i}", "A1" if i % 2 else "C2") for i in range(120)]
    paths = [str(tmp_path / n) for n in ("train", "test")]
    for path, own in zip(paths, (rows[:90], rows[90:])):
        spark.createDataFrame(own, "id long, text string, label string").write.parquet(path)
    run = tr.train_on_files(spark, *paths, ft.FitSettings(num_features=128), fmt="parquet", allow_rare=True)
    assert {r["split"]: r["n"] for r in run.split_sizes.collect()}["test"] == 30
    assert {r["id"] for r in run.scored_test.collect()} == set(range(90, 120))
    assert run.report["overall"].first()["accuracy"] == 1.0
