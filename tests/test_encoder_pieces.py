"""The caller's own encoders, subword pieces, and pooling inside the row."""

import os
import random

import numpy as np
import pytest

from levelwise.operators.encode import encode_corpus, learn_vocabulary
from levelwise.operators.encoder import Encoder, encode_with, score_encoded
from levelwise.operators.pieces import cut_word, encode_pieces, piece_tries, read_pieces
from levelwise.operators.pooling import embed_text, mean_pool
from levelwise.operators.requests import score_requests


def text_encoder(log, batch_rows=7):
    """Length, vowels and batch size of each text; notes every load and batch."""
    def load():
        with open(f"{log}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def encode(texts):
            with open(f"{log}/batches", "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), sum(c in "aeiou" for c in t), len(texts)] for t in texts.to_pylist()])

        return encode

    return Encoder(load, 3, batch_rows)


def lines(path):
    return [int(x) for x in path.read_text().split()]


def test_an_encoder_is_loaded_once_per_worker_and_gets_fixed_batches(spark, tmp_path):
    df = spark.range(0, 200, 1, 12).selectExpr("id", "repeat('ab', cast(id % 5 as int)) AS sentence")
    rows = encode_with(df, text_encoder(tmp_path), output="v").collect()
    assert {(r["id"], *r["v"][:2]) for r in rows} == {(i, i % 5 * 2.0, i % 5 * 1.0) for i in range(200)}
    loads, batches = lines(tmp_path / "loads"), lines(tmp_path / "batches")
    assert len(loads) == len(set(loads)) <= 12
    # Twelve partitions of 16 or 17 rows: batches of seven and one rest each.
    assert sum(batches) == 200 and set(batches) <= {7, 2, 3}


def test_nulls_empty_tables_and_wrong_widths(spark, tmp_path):
    df = spark.createDataFrame([(1, "aeiou"), (2, None), (None, ""), (2, None)], "id int, sentence string")
    got = {(r["id"], None if r["v"] is None else tuple(r["v"][:2])) for r in encode_with(df, text_encoder(tmp_path), output="v").collect()}
    assert got == {(1, (5.0, 5.0)), (2, None), (None, (0.0, 0.0))}
    assert encode_with(df.limit(0), text_encoder(tmp_path), output="v").collect() == []
    with pytest.raises(ValueError):
        encode_with(df, text_encoder(tmp_path), output="id")
    with pytest.raises(Exception, match="the encoder returned"):
        encode_with(df, Encoder(lambda: lambda texts: np.zeros((len(texts), 2)), 3), output="v").collect()


def test_requests_are_scored_by_the_callers_encoder(spark, tmp_path):
    requests = spark.createDataFrame([("a", ["aa", " ", "bbbb"]), ("b", [])], "request_id string, sentences array<string>")
    head = [[0.0, float(k == 5), 0.0] for k in range(6)]
    rows = score_requests(requests, lambda r: score_encoded(r, text_encoder(tmp_path), head), ordered=True).collect()
    assert [(r["request_id"], r["pos"], r["cefr"], r["status"]) for r in rows] == [
        ("a", 0, "C2", "ok"), ("a", 2, "A1", "ok"), ("b", None, None, "no_sentences")]


def plain_cut(word, pieces, continuing="", ending=""):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            key = (continuing if at else "") + word[at:end] + (ending if ending and end == len(word) else "")
            if key in pieces:
                out.append(pieces[key])
                at = end
                break
        else:
            return [1]
    return out


@pytest.mark.parametrize("marks", [("", ""), ("##", ""), ("", "</w>")])
def test_longest_pieces_equal_a_plain_search(marks):
    chance = random.Random(3)
    make = lambda: "".join(chance.choice("abcé") for _ in range(chance.randint(1, 4)))
    pieces = {f"{marks[0] * chance.randint(0, 1)}{make()}{marks[1] * chance.randint(0, 1)}": i + 4 for i in range(60)}
    tries = piece_tries(pieces, *marks)
    for _ in range(500):
        word = "".join(chance.choice("abcé") for _ in range(chance.randint(1, 9)))
        assert cut_word(word, *tries) == plain_cut(word, pieces, *marks), word


def test_encoding_of_pieces_keeps_rows_and_lengths(spark):
    pieces = {"un": 4, "known": 5, "k": 6, "n": 7, "ow": 8}
    df = spark.createDataFrame([(1, "unknown known"), (1, "unknown"), (None, "zebra n"), (2, None), (3, ""), (4, "k " * 20)], "id long, text string")
    table = spark.createDataFrame(list(pieces.items()), "token string, token_id int")
    rows = sorted((str(r["id"]), r["input_ids"], r["attention_mask"]) for r in encode_pieces(df, table, max_length=6).collect())
    assert rows == [
        ("1", [2, 4, 5, 3, 0, 0], [1, 1, 1, 1, 0, 0]), ("1", [2, 4, 5, 5, 3, 0], [1, 1, 1, 1, 1, 0]), ("2", [2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
        ("3", [2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]), ("4", [2, 6, 6, 6, 6, 3], [1] * 6), ("None", [2, 1, 7, 3, 0, 0], [1, 1, 1, 1, 0, 0])]


def test_pieces_of_a_public_vocabulary(spark):
    import public_tokenizers

    pieces = read_pieces(spark, public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(0, "the cat sat unbelievably")], "id long, text string")
    row = encode_pieces(df, pieces, max_length=16, ending="</w>").first()
    known = {r["token"]: r["token_id"] for r in pieces.collect()}
    ids = [i for i in row["input_ids"] if i > 3]
    names = {i: t for t, i in known.items()}
    assert "".join(names[i] for i in ids).replace("</w>", " ") == "the cat sat unbelievably "


def test_repeated_and_missing_ids_keep_their_own_words(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c a b"), (1, "c c c c c"), (None, "b a"), (2, None)], "id long, text string")
    vocabulary = learn_vocabulary(df, 5)
    constant = sorted(map(str, encode_corpus(df, vocabulary, max_length=8).collect()))
    monkeypatch.setattr("levelwise.operators.encode.MAX_VOCABULARY", 2)
    assert sorted(map(str, encode_corpus(df, vocabulary, max_length=8).collect())) == constant
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0])], "token string, vector array<double>")
    got = sorted((str(r["id"]), [round(x, 9) for x in r["pooled"]]) for r in embed_text(df, vectors, 2).collect())
    assert got == [("1", [0.8, 0.8]), ("1", [2.0, 2.0]), ("2", [0.0, 0.0]), ("None", [0.5, 0.5])]


def test_texts_longer_than_a_portion(spark, monkeypatch):
    monkeypatch.setattr("levelwise.operators.pooling.PORTION", 10)
    texts = ["a " * 37 + "b " * 5, "", "b", "a b z " * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    got = {r["id"]: [round(x, 9) for x in r["pooled"]] for r in embed_text(df, vectors, 2).collect()}
    assert got == {0: [round(37 / 42, 9), round(5 / 42, 9)], 1: [0.0, 0.0], 2: [0.0, 1.0], 3: [0.5, 0.5]}


def test_wide_vectors_pool_as_numpy(spark):
    g = np.random.default_rng(1)
    data = [(int(i % 5), g.standard_normal(768).tolist(), int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, vec array<double>, mask int")
    for r in mean_pool(df, 768, mask="mask").collect():
        own = np.array([v for i, v, m in data if i == r["id"] and m])
        assert np.allclose(r["pooled"], own.mean(axis=0), atol=1e-12)
