import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelwise.operators.split import shuffle_rows, stratified_quotas, stratified_split
from levelwise.operators.weights import attach_class_weight, class_ratios, class_weights, counts_with_pct, label_counts

COUNTS = [70, 239, 309, 233, 105, 44]


def labelled(spark, counts):
    rows, i = [], 0
    for label, n in enumerate(counts):
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label_id int")


def remainder_shares(sizes, draws):
    total = sum(sizes)
    shares = [s * draws // total for s in sizes]
    order = sorted(range(len(sizes)), key=lambda c: (-(sizes[c] * draws % total), c))
    for c in order[: draws - sum(shares)]:
        shares[c] += 1
    return shares


def brute_split(rows, seed=42):
    labels = sorted({y for _, y in rows})
    sizes = [sum(y == c for _, y in rows) for c in labels]
    hold = math.ceil(0.3 * len(rows) - 1e-9)
    test = math.ceil(hold / 2)
    train = remainder_shares(sizes, len(rows) - hold)
    val = remainder_shares([s - t for s, t in zip(sizes, train)], hold - test)
    out = {}
    for k, c in enumerate(labels):
        ids = sorted((hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i) for i, y in rows if y == c)
        for rank, (_, i) in enumerate(ids):
            out[i] = "train" if rank < train[k] else "val" if rank < train[k] + val[k] else "test"
    return out


def test_golden_quotas(spark):
    counts = spark.createDataFrame(list(enumerate(COUNTS)), "label_id int, n long")
    rows = stratified_quotas(counts).orderBy("label_id").collect()
    assert [r["train"] for r in rows] == [49, 167, 216, 163, 74, 31]
    assert [r["val"] for r in rows] == [11, 36, 47, 35, 15, 6]
    assert [r["test"] for r in rows] == [10, 36, 46, 35, 16, 7]


def test_quotas_do_not_overflow(spark):
    sizes = [33_333_333_333, 1_234_567, 99_999_999_999, 2, 17, 5_000_000_000]
    counts = spark.createDataFrame(list(enumerate(sizes)), "label_id int, n long")
    rows = stratified_quotas(counts).orderBy("label_id").collect()
    n = sum(sizes)
    hold = -(-3 * n // 10)
    train = remainder_shares(sizes, n - hold)
    val = remainder_shares([s - t for s, t in zip(sizes, train)], hold - -(-hold // 2))
    assert [r["train"] for r in rows] == train
    assert [r["val"] for r in rows] == val


@pytest.mark.parametrize("counts", [COUNTS, [900, 2, 30, 2, 7, 59], [10, 10]])
def test_split_equals_brute_force(spark, counts):
    df = labelled(spark, counts)
    got = {r["id"]: r["split"] for r in stratified_split(df).collect()}
    assert got == brute_split([tuple(r) for r in df.collect()])


def test_split_ignores_partitioning_and_is_complete(spark):
    df = labelled(spark, [60, 25, 15])
    a = stratified_split(df.repartition(7))
    b = stratified_split(df.orderBy(F.desc("id")).coalesce(1))
    assert a.exceptAll(b).count() == 0 and a.count() == 100
    assert a.columns == ["id", "label_id", "split"]
    other = stratified_split(df, seed=7)
    assert a.exceptAll(other).count() > 0
    assert [r["n"] for r in counts_with_pct(a, "split").orderBy("split").collect()] == [15, 70, 15]


def test_skewed_label(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") < 19000, 0).otherwise(1).alias("label_id"))
    got = {(r["label_id"], r["split"]): r["count"] for r in stratified_split(df).groupBy("label_id", "split").count().collect()}
    assert got == {(0, "train"): 13300, (0, "val"): 2850, (0, "test"): 2850, (1, "train"): 700, (1, "val"): 150, (1, "test"): 150}


def test_rare_labels_are_refused_or_trained_on(spark):
    df = labelled(spark, [40, 1])
    with pytest.raises(Exception, match="too few of A2"):
        stratified_split(df).collect()
    rows = stratified_split(df, allow_rare=True).collect()
    assert len(rows) == 41
    assert [r["split"] for r in rows if r["label_id"] == 1] == ["train"]


def test_too_small_split_is_refused(spark):
    with pytest.raises(Exception, match="smaller than the number of labels"):
        stratified_split(labelled(spark, [2, 2, 2])).collect()


def test_missing_label_is_refused(spark):
    df = labelled(spark, [20, 20]).union(spark.createDataFrame([(99, None)], "id long, label_id int"))
    with pytest.raises(Exception, match="no label"):
        stratified_split(df).collect()


def test_shuffle_is_reproducible(spark):
    a = [r["id"] for r in shuffle_rows(spark.range(200)).collect()]
    b = [r["id"] for r in shuffle_rows(spark.range(200).repartition(9)).collect()]
    assert a == b and sorted(a) == list(range(200)) and a != sorted(a)
    assert a == sorted(range(200), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())


def test_golden_weights(spark):
    rows = class_weights(labelled(spark, COUNTS)).orderBy("label_id").collect()
    assert [r["weight"] for r in rows] == pytest.approx([1.6248, 0.8794, 0.7734, 0.8907, 1.3267, 2.0493], abs=1e-4)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_weights_match_numpy(spark, alpha):
    counts = [30, 0, 5, 100, 0, 1]
    rows = class_weights(labelled(spark, counts), alpha=alpha).orderBy("label_id").collect()
    seen = np.array([c for c in counts if c], dtype=float)
    r = seen / seen.sum()
    expected = np.ones(6)
    expected[[0, 2, 3, 5]] = r**alpha / (r**alpha).sum() / (r + 1e-5)
    assert [x["weight"] for x in rows] == pytest.approx(list(expected))


def test_attach_and_counts(spark):
    df = labelled(spark, [3, 1])
    weighted = attach_class_weight(df, class_weights(df))
    assert weighted.count() == 4 and weighted.where("weight is null").count() == 0
    assert [(r["label_id"], r["n"]) for r in label_counts(df, "label_id").collect()] == [(0, 3), (1, 1)]
    assert {r["label_id"]: r["ratio"] for r in class_ratios(df).collect()} == {0: 0.75, 1: 0.25}
