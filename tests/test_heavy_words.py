"""Frequent words from bounded summaries equal a full count."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from levelwise.operators import heavy_words as hw
from levelwise.operators.encode import learn_vocabulary


def zipf_texts(spark, seed=3, parts=5):
    rng = np.random.default_rng(seed)
    texts = [[f"w{i}" for i in rng.zipf(1.4, 200) % 5000] for _ in range(60)]
    rows = [(" ".join(t),) for t in texts] + [(None,), ("",), ("--",)]
    return spark.createDataFrame(rows, "text string").repartition(parts), Counter(w for t in texts for w in t)


def listed(table):
    return [(r["token"], r["token_id"], r["n"]) for r in table.orderBy("token_id").collect()]


@pytest.mark.parametrize("counters", [1, 40, 150, 10_000])
def test_heavy_words_match_a_full_count(spark, counters):
    df, counts = zipf_texts(spark)
    best = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    expected = [(w, i + 4, counts[w]) for i, w in enumerate(best)]
    assert listed(hw.heavy_words(df, 20, counters=counters)) == expected == listed(learn_vocabulary(df, 20))


def test_summaries_bound_every_count(spark):
    df, counts = zipf_texts(spark, seed=4, parts=3)
    rows = hw.summaries(df, 50).collect()
    loss = sum(r["n"] for r in rows if r["token"] is None)
    found = Counter()
    for r in rows:
        if r["token"] is not None:
            found[r["token"]] += r["n"]
    assert loss > 0 and len(rows) <= 3 * 51
    assert all(found[w] <= n <= found[w] + loss for w, n in counts.items())


def test_second_pass_counts_candidates_only(spark, monkeypatch):
    df, counts = zipf_texts(spark)
    seen = []
    plain = hw.counted
    monkeypatch.setattr(hw, "counted", lambda d, c, t: seen.append(c.count()) or plain(d, c, t))
    hw.heavy_words(df, 3, counters=300)
    assert len(seen) == 1 and 3 <= seen[0] < len(counts)
    monkeypatch.setattr(hw, "MAX_VOCABULARY", 1)
    assert listed(hw.heavy_words(df, 3, counters=300)) == listed(learn_vocabulary(df, 3))


def test_too_many_counters_fall_back_to_a_full_count(spark, monkeypatch):
    df, _ = zipf_texts(spark)
    monkeypatch.setattr(hw, "MAX_COUNTERS", 4)
    assert listed(hw.heavy_words(df, 30, counters=2)) == listed(learn_vocabulary(df, 30))


def test_without_words(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert hw.heavy_words(df, 5).count() == 0 and hw.heavy_words(df.limit(0), 5).count() == 0
    for size, counters in ((0, None), (1, 0)):
        with pytest.raises(ValueError):
            hw.heavy_words(df, size, counters=counters)


def test_reduction():
    table = pa.table({"token": ["a", "b", "c", "d"], "n": pa.array([5, 3, 3, 1], pa.int64())})
    left, taken = hw.reduced(table, 2)
    assert taken == 3 and left.to_pydict() == {"token": ["a"], "n": [2]}
    assert hw.reduced(table, 4) == (table, 0)
