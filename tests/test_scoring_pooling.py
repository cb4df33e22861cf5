import numpy as np
import pytest
from pyspark.sql import functions as F

from levelwise.functions.scoring import argmax_label, confidence, linear_head, softmax
from levelwise.operators.encode import MAX_VOCABULARY, bucket, encode_corpus, learn_vocabulary
from levelwise.operators.pooling import embed_text, mean_pool, mean_pool_nested
from levelwise.operators.score import score_linear


def test_scores_match_numpy(spark):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(40, 9)), rng.normal(size=(6, 9)), rng.normal(size=6)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, features array<double>")
    logits = x @ w.T + b
    probs = np.exp(logits - logits.max(1, keepdims=True))
    probs /= probs.sum(1, keepdims=True)
    rows = df.withColumn("l", linear_head("features", w.tolist(), b.tolist())).withColumn("p", softmax("l")).orderBy("id").collect()
    assert np.allclose([r["l"] for r in rows], logits)
    assert np.allclose([r["p"] for r in rows], probs)
    scored = score_linear(df, w.tolist(), b.tolist()).orderBy("id").collect()
    assert [r["pred_id"] for r in scored] == logits.argmax(1).tolist()
    assert np.allclose([r["confidence"] for r in scored], probs.max(1))
    assert all(r["confidence"] >= 1 / 6 for r in scored)


def test_ties_and_large_logits(spark):
    df = spark.createDataFrame([([1.0] * 6,), ([1e4, 0.0, 0.0, 0.0, 0.0, 1e4],), (None,)], "l array<double>")
    rows = df.select(argmax_label("l").alias("a"), confidence(softmax("l")).alias("c"), softmax("l").alias("p")).collect()
    assert rows[0]["a"] == 0 and rows[0]["c"] == pytest.approx(1 / 6)
    assert rows[1]["a"] == 0 and rows[1]["c"] == pytest.approx(0.5)
    assert rows[2]["p"] is None and rows[2]["c"] is None


def test_bias_must_fit(spark):
    with pytest.raises(ValueError):
        linear_head("x", [[1.0]], [1.0, 2.0])


TOKENS = [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)]


def test_pooling_golden(spark):
    df = spark.createDataFrame(TOKENS, "id string, vec array<double>, mask int")
    got = {r["id"]: r["pooled"] for r in mean_pool(df, 2, mask="mask").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    nested = df.groupBy("id").agg(F.collect_list("vec").alias("v"), F.collect_list("mask").alias("m"))
    assert {r["id"]: r["p"] for r in nested.select("id", mean_pool_nested("v", "m", 2).alias("p")).collect()} == got


def test_pooling_hot_group_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, group, mask = rng.normal(size=(3000, 5)), np.where(rng.random(3000) < 0.7, 0, rng.integers(0, 9, 3000)), rng.integers(0, 2, 3000)
    df = spark.createDataFrame(
        [(int(g), [float(v) for v in r], int(m)) for g, r, m in zip(group, x, mask)], "id int, vec array<double>, mask int"
    ).repartition(6)
    for r in mean_pool(df, 5, mask="mask").collect():
        own = x[(group == r["id"]) & (mask == 1)]
        assert np.allclose(r["pooled"], own.mean(0))


TEXTS = ["the cat saw the dog", "", "!!! 123", "the the the", "a b c d e f g h i j", None, "größer niño 2024 Привет café 日本 Ωmega"]


def encoded(texts, vocabulary, length):
    import re

    out = []
    for t in texts:
        ids = [2] + [vocabulary.get(w, 1) for w in re.findall(r"[^\W_]+", (t or "").lower())][: length - 2] + [3]
        out.append((ids + [0] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))))
    return out


@pytest.mark.parametrize("length, size", [(8, 3), (8, 100), (128, 5)])
def test_encode_matches_brute_force(spark, length, size):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    vocabulary = learn_vocabulary(df, size)
    learned = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    assert len(learned) <= size and learned["the"] == 4 and min(learned.values()) == 4
    rows = encode_corpus(df, vocabulary, max_length=length).orderBy("id").collect()
    assert [(r["input_ids"], r["attention_mask"]) for r in rows] == encoded(TEXTS, learned, length)


def test_encode_with_an_empty_vocabulary(spark):
    df = spark.createDataFrame([(0, "a b")], "id int, text string")
    row = encode_corpus(df, learn_vocabulary(df, 5).limit(0), max_length=5).first()
    assert row["input_ids"] == [2, 1, 1, 3, 0]


def test_vocabulary_size(spark):
    df = spark.createDataFrame([(0, "b b a c"), (1, "d")], "id int, text string")
    with pytest.raises(ValueError):
        learn_vocabulary(df, 0)
    for size in (1, 2, 3, MAX_VOCABULARY + 1):
        rows = learn_vocabulary(df, size).orderBy("token_id").collect()
        assert [(r["token"], r["token_id"]) for r in rows] == [("b", 4), ("a", 5), ("c", 6), ("d", 7)][:size]


def test_vocabulary_matches_brute_force(spark):
    from collections import Counter

    rng = np.random.default_rng(2)
    words = [[f"w{i}" for i in rng.zipf(1.3, 40) % 700] for _ in range(60)]
    counts = Counter(w for text in words for w in text)
    df = spark.createDataFrame([(" ".join(text),) for text in words], "text string").repartition(5)
    expected = sorted(counts, key=lambda w: (-counts[w], w))
    for size in (10, len(counts) - 3, len(counts) + 5):
        rows = learn_vocabulary(df, size).orderBy("token_id").collect()
        assert [(r["token"], r["n"]) for r in rows] == [(w, counts[w]) for w in expected[:size]]
        assert [r["token_id"] for r in rows] == list(range(4, 4 + len(rows)))


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    vocabulary = learn_vocabulary(df, 5)
    constant = encode_corpus(df, vocabulary, max_length=8).orderBy("id").collect()
    monkeypatch.setattr("levelwise.operators.encode.MAX_VOCABULARY", 3)
    assert encode_corpus(df, vocabulary, max_length=8).orderBy("id").collect() == constant


def test_wrong_lengths_fail(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1), ("a", None, 1)], "id string, vec array<double>, mask int")
    with pytest.raises(Exception, match="expected 2 values, got 3"):
        mean_pool(df, 2, mask="mask").collect()
    with pytest.raises(Exception, match="expected 2 values, got 3"):
        df.select(linear_head("vec", [[1.0, 1.0]])).collect()
    with pytest.raises(Exception, match="expected 6 values, got 3"):
        df.select(softmax("vec", 6)).collect()
    with pytest.raises(Exception, match="expected 2 values, got 3"):
        df.groupBy("id").agg(F.collect_list("vec").alias("v")).select(mean_pool_nested("v", F.array(F.lit(1)), 2)).collect()
    assert mean_pool(df, 3, mask="mask").first()["pooled"] == [1.0, 2.0, 3.0]  # the missing vector is masked


def test_softmax_of_any_length(spark):
    values = [0.5, -1.0, 2.0, 0.0, 3.0, 1.0, 9.0, 8.5]
    row = spark.createDataFrame([(values,)], "l array<double>").select(softmax("l").alias("a"), softmax("l", 8).alias("b")).first()
    expected = np.exp(values) / np.exp(values).sum()
    assert np.allclose(row["a"], expected) and np.allclose(row["b"], expected)


def test_embed_text(spark):
    df = spark.createDataFrame([(0, "x y y z"), (1, "unknown words"), (2, "")], "id int, text string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "token string, vector array<double>")
    got = {r["id"]: r["pooled"] for r in embed_text(df, vectors, 2).collect()}
    assert got[0] == pytest.approx([1 / 3, 2 / 3]) and got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0]


def test_unknown_words_use_buckets(spark):
    df = spark.createDataFrame([(0, "x zz"), (1, "")], "id int, text string")
    names = [r["b"] for r in spark.createDataFrame([("zz",), ("ü",)], "w string").select(bucket("w", 5).alias("b")).collect()]
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), (names[0], [0.0, 3.0])], "token string, vector array<double>")
    got = {r["id"]: r["pooled"] for r in embed_text(df, vectors, 2, buckets=5).collect()}
    assert got == {0: [0.5, 1.5], 1: [0.0, 0.0]} and names[1].startswith("#")
