"""Decontamination, top-k search and chat formatting against plain versions."""

import random

import numpy as np
import pytest

import brute
from conftest import AWKWARD
from levelwise.llm import chat, decontaminate, maxscore

rng = random.Random(5)


def passages():
    pool = [f"t{i}" for i in range(40)] + ["the"] * 20
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 9, 10, 11, 30))))) for i in range(12)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, "the"), (104, "Élan VITAL")]
    texts = [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(30)]
    for k, (_, text) in enumerate(items[:12]):
        texts.append(f"before-{k}, {text.upper()}! after " + text)
        texts.append(" ".join(text.split()[:-1]))
    return items, texts + [None, "", "élan vital", "... the", "thethe"]


@pytest.mark.parametrize("limit", [100_000, 20])
def test_phrases_match_brute_force(spark, docs, limit):
    items, texts = passages()
    found = decontaminate.contamination(docs(*enumerate(texts)), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    assert {r._did: (r.n_words, r.n_hit, list(r.item_ids)) for r in found} == {i: brute.hits(t, items) for i, t in enumerate(texts)}


def test_bitmap_lets_all_sought_hashes_pass(spark):
    from pyspark.sql import functions as F

    sought = spark.range(300).select(F.xxhash64("id").alias("h"))
    others = spark.range(1000, 4000).select(F.xxhash64("id").alias("h"))
    for longs in (decontaminate.BITMAP_LONGS, 40, 1):
        passes = decontaminate.bitmap(sought, 300, longs)
        assert sought.filter(passes(F.col("h"))).count() == 300
        if longs > 40:
            assert others.filter(passes(F.col("h"))).count() < 600


def test_large_benchmarks_take_two_passes(spark, docs, monkeypatch):
    items, texts = passages()
    staged = []
    plain = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: staged.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))) or plain(df, name))
    decontaminate.contamination(docs(*enumerate(texts)), spark.createDataFrame(items, "item_id long, text string"), limit=5)
    assert [name for name, _ in staged].count("tokens") == 1
    assert dict(staged)["tokens"] == dict(staged)["term-counts"] == 1 and dict(staged)["postings"] == 0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_proximity_ignores_order_within_reach_of_any_benchmark(spark, docs, limit):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    texts = docs((1, "gamma x beta y alpha"), (2, "alpha beta"), (3, "alpha b c d e f g beta gamma"), (4, "u " * 30 + "beta gamma alpha" + " v" * 30))
    index = decontaminate.PositionalIndex(texts, items, reach=4, limit=limit)
    assert sorted(r._did for r in index.near().collect()) == [1, 4]


def test_proximity_ignores_order_within_reach(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.PositionalIndex(docs((1, "gamma x beta y alpha"), (2, "alpha beta"), (3, "alpha b c d e f g beta gamma")), items, reach=4)
    assert [r._did for r in index.near().collect()] == [1]
    with pytest.raises(ValueError):
        index.phrases()


def test_decontamination_awkward_rows(spark, awkward, docs):
    items = spark.createDataFrame([(1, "same text in two documents"), (None, "words without"), (2, None)], "item_id long, text string")
    rows = decontaminate.contamination(awkward, items).collect()
    assert len(rows) == len(set(AWKWARD))
    kept = decontaminate.clean_documents(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 4
    assert decontaminate.contamination(docs(), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(awkward, items.limit(0)).collect()} == {0}


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string")


def best(rows, query, k=5):
    scored = sorted((-int(np.dot(np.floor(256 * np.array(v, "float32").astype(float)), query[1])), i) for i, v in rows if i != query[0])
    return [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]


@pytest.mark.parametrize("blocks", [(8192, 1024), (16, 3)])
def test_top_k_matches_brute_force(spark, blocks):
    g = np.random.default_rng(6)
    rows = [(i, (g.normal(size=12) * (g.random(12) < 0.6)).astype("float32").tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(9)]  # ties
    table = vectors_table(spark, [(i, v, 0, None) for i, v in rows])
    v = maxscore.integer_vectors(table)
    found = maxscore.top_k(v, v.filter("vec_id % 5 = 0"), 5, *blocks).collect()
    for query_id, vector in rows:
        if query_id % 5 == 0:
            own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query_id)
            assert own == best(rows, (query_id, np.floor(256 * np.array(vector, "float32").astype(float))))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (0, [1.0, 0.0], 0, ""), (1, None, 0, ""), (2, [None, 1.0], 0, ""), (3, [float("nan"), 1.0], 0, ""),
            (4, [float("inf"), 1.0], 0, ""), (None, [1.0, 1.0], 0, ""), (5, [0.5], 0, ""), (6, [], 0, ""), (7, [-0.001, 3.4e38], 0, "")]
    v = maxscore.integer_vectors(vectors_table(spark, rows))
    found = maxscore.top_k(v.dropDuplicates(), v.dropDuplicates().filter("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 5, 256 * 128), (2, 6, 0), (3, 7, -256)]
    empty = v.limit(0)
    assert maxscore.top_k(empty, empty).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0], 0, ""), (1, [big, 1.0], 0, ""), (2, [big, 0.5], 0, "")]
    v = maxscore.integer_vectors(vectors_table(spark, rows), scale=1)
    found = maxscore.top_k(v, v.filter("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**63 - 1), (2, 2**63 - 1)] and 2**80 > 2**63


TURNS = "conv_id long, turn long, role string, text string, pos int, n int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], TURNS)


@pytest.mark.parametrize("block", [256, 2])
def test_maximal_conversations_match_brute_force(spark, block):
    rows = []
    for c in range(60):
        n = rng.randint(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(("hi", "yes", "ü"))) for t in range(n)]
    rows += [(100, 0, None, "hi"), (101, 0, "unknown", "hi"), (102, 0, "user", None), (103, 0, "user", ""), (None, None, "user", "x"), (None, 1, "user", "y"),
             (104, 0, "user", "twice"), (104, 0, "user", "twice"), (105, 0, "user", "twice")]
    found = chat.format_chats(turns_of(spark, rows), block).collect()
    assert {r.conv_id for r in found} == brute.maximal(rows)
    whole = {}
    for r in sorted(found, key=lambda r: r.segment):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert whole[104] == "<|user|>\ntwice<|end|>\n" * 2
    assert whole[None] == "<|user|>\nx<|end|>\n<|user|>\ny<|end|>\n"
    assert sum(r.n_turns for r in found) == sum(1 for r in rows if r[0] in whole)


def test_no_conversations(spark):
    assert chat.format_chats(turns_of(spark, [])).count() == 0


def test_segments_follow_positions_whatever_the_turn_numbers(spark):
    rows = [(None, None, "user", f"t{i:05}") for i in range(1000)] + [(1, 7, "user", f"u{i:05}") for i in range(700)] + [(2, 10 * i, "user", "far") for i in range(40)]
    rows += [(3, 0, None, "again")] * 900 + [(4, 0, None, "again")] * 300
    found = chat.format_chats(turns_of(spark, rows), 64).collect()
    assert max(r.n_turns for r in found) == 64
    assert {r.conv_id for r in found} == {None, 1, 2, 3}
    for conv, n in ((None, 1000), (1, 700), (2, 40), (3, 900)):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.segment)
        assert [(r.segment, r.first_turn) for r in own] == [(i, 64 * i) for i in range(-(-n // 64))]
        expected = [f"<|{role or 'unknown'}|>\n{text}<|end|>\n" for c, _, role, text in rows if c == conv]
        assert "".join(r.rendered for r in own) == "".join(expected)


@pytest.mark.parametrize("most", [1, 60, 500])
def test_long_blocks_are_cut_by_bytes(spark, most):
    rows = [(1, i, "user", "x" * (i % 50)) for i in range(100)] + [(2, 0, "user", "again")] * 90 + [(3, 0, "user", "short"), (4, 0, "user", "z" * 1000)]
    found = chat.format_chats(turns_of(spark, rows), 64, most).collect()
    assert {r.conv_id for r in found} == {1, 2, 3, 4}
    for conv in (1, 2, 3, 4):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.segment, r.first_turn))
        texts = sorted(text for c, _, _, text in rows if c == conv) if conv != 1 else [text for c, _, _, text in rows if c == conv]
        expected = [f"<|user|>\n{text}<|end|>\n" for text in texts]
        assert "".join(r.rendered for r in own) == "".join(expected)
        assert [r.first_turn for r in own] == [sum(r.n_turns for r in own[:i]) for i in range(len(own))]
        assert all(r.segment == r.first_turn // 64 for r in own)
        assert max(len(r.rendered) for r in own) < most + max(map(len, expected))
