import random
from collections import Counter

import numpy as np
import pytest

from levelwise.operators import pair_vectors as pv
from levelwise.plans import fit as ft

NEAR = {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}


def brute(texts, size):
    counts = Counter()
    for text in texts:
        for p, i in enumerate(text):
            counts[-1 - i] += 1
            for distance, weight in NEAR.items():
                if p + distance < len(text):
                    j = text[p + distance]
                    counts[min(i, j) * size + max(i, j)] += weight
    return dict(counts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [[rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(60)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_every_near_pair_of_every_text_is_counted(spark, texts, partitions):
    rows = [([str(i) for i in text],) for text in texts] + [(None,)]
    df = spark.createDataFrame(rows, "counts array<string>").repartition(partitions)
    assert {r["key"]: r["n"] for r in pv.pair_counts(df, "counts", 9, int).collect()} == brute(texts, 9)


@pytest.mark.parametrize("portion", [1, 3, 1000])
def test_pairs_across_portions(texts, monkeypatch, portion):
    monkeypatch.setattr(pv, "PORTION", portion)
    at = np.array([i for text in texts for i in text])
    text_of = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    held = [pv.portion_counts(at, text_of, low, 9) for low in range(0, len(at), portion)]
    keys, n = pv.merged(held)
    assert dict(zip(keys.tolist(), n.tolist())) == brute(texts, 9)


def likelihood(i, j, n, words, near):
    logits = words @ near.T
    return (n * (logits - np.log(np.exp(logits).sum(1))[:, None])[i, j]).sum()


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_gradient_of_the_likelihood(spark, monkeypatch, cells):
    monkeypatch.setattr(pv, "CELLS", cells)
    rng = np.random.default_rng(1)
    i, j = np.nonzero(rng.random((6, 6)) < 0.5)
    n = rng.integers(1, 9, len(i))
    words, near = rng.normal(size=(2, 6, 3))
    pairs = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), n.tolist())), "i int, j int, n long")
    found = pv.gradients(pv.blocks(pairs, 2), words, near)
    for side in (0, 1):
        for at in np.ndindex(6, 3):
            moved = np.zeros((2, 6, 3))
            moved[(side, *at)] = 1e-6
            up, down = (likelihood(i, j, n, words + s * moved[0], near + s * moved[1]) for s in (1, -1))
            assert found[side][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def sentences(times):
    rng = random.Random(5)
    pets, cars = ["cat", "dog", "hen"], ["bus", "van", "car"]
    made = [f"the {rng.choice(pets)} eats grass" for _ in range(60)] + [f"a {rng.choice(cars)} takes petrol" for _ in range(60)] + ["alone"]
    return [(text,) for text in made * times]


def test_vectors_follow_the_shares_of_the_pairs_not_the_size_of_the_corpus(spark):
    """Three copies of a corpus have the same pairs, three times as often: the training does the same on them."""
    once, thrice = (
        {r["token"]: np.array(r["vector"]) for r in ft.learn_token_vectors(
            spark.createDataFrame(sentences(times), "text string").repartition(times + 1), vocabulary_size=50, dim=4).collect()}
        for times in (1, 3))
    assert once.keys() == thrice.keys() and len(once) == 13
    for token, vector in once.items():
        assert thrice[token] == pytest.approx(vector, abs=1e-6)


def test_words_of_the_same_company_are_near(spark):
    rows = ft.learn_token_vectors(spark.createDataFrame(sentences(1), "text string"), vocabulary_size=50, dim=4).collect()
    v = {r["token"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in rows}
    assert min(v["cat"] @ v["dog"], v["bus"] @ v["van"]) > max(v["cat"] @ v["bus"], v["dog"] @ v["van"])
    # A word that is never near another has a vector all the same.
    assert v["alone"].any()


def test_texts_without_words_have_no_vectors(spark):
    df = spark.createDataFrame([("",), (None,), ("...",)], "text string")
    assert ft.learn_token_vectors(df, vocabulary_size=5, dim=3).count() == 0


def test_pooled_features_follow_the_shares_of_the_pairs(spark):
    settings = ft.FitSettings(features="embedding", dim=4, num_features=8)
    rows = [(["1", "2", "3"],), (["2", "1", "5"],), (["6"],)]
    df = spark.createDataFrame(rows + [([],)], "counts array<string>")
    first, second = (
        {tuple(r["counts"]): r["features"].toArray() for r in ft.fit_features(
            spark.createDataFrame(rows * times, "counts array<string>"), settings).transform(df).collect()} for times in (1, 4))
    for counts, features in first.items():
        assert second[counts] == pytest.approx(features, abs=1e-6)
        assert features.any() == bool(counts)


def test_a_bucket_never_seen_counts_as_zeros(spark):
    settings = ft.FitSettings(features="embedding", dim=4, num_features=8)
    step = ft.fit_features(spark.createDataFrame([(["1", "2"],)], "counts array<string>"), settings)
    seen, half = (r["features"].toArray() for r in step.transform(
        spark.createDataFrame([(0, ["1"]), (1, ["1", "7"])], "id int, counts array<string>")).orderBy("id").collect())
    assert seen.any() and half == pytest.approx(seen / 2)
