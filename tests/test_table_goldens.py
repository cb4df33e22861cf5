"""Known results on the given tables."""

import __spark_entry__ as contract

SF = "/root/testdata/sf0.01"
QUERIES = contract.queries()


def test_confusion_diagonal(spark):
    rows = QUERIES["confusion_matrix"](spark, SF).collect()
    diagonal = sorted((r["true_id"], r["n"]) for r in rows if r["true_id"] == r["pred_id"])
    assert [n for _, n in diagonal] == [56, 160, 207, 172, 73, 38]
    assert sum(r["n"] for r in rows) == 1000 and sum(r["n"] > 0 for r in rows) == 16


def test_encoding_of_the_first_document(spark):
    row = QUERIES["encode_corpus_short"](spark, SF).where("id = 0").first()
    assert row["input_ids"] == "2 1 1 1 23 1 1 1 39 10 1 98 1 6 1 3"


def test_split_sizes(spark):
    got = {r["split"]: (r["n"], r["pct"]) for r in QUERIES["split_sizes"](spark, SF).collect()}
    assert got == {"train": (700, 70.0), "val": (150, 15.0), "test": (150, 15.0)}


def test_entry_is_the_class_report(spark):
    rows = contract.entry(spark).collect()
    assert [r["position"] for r in rows] == list(range(9))
    assert sum(r["support"] for r in rows[:6]) == 30


def test_stream_and_batch_queries_agree(spark, sf_dir):
    batch, stream = QUERIES["score_request_log"](spark, sf_dir), QUERIES["score_stream"](spark, sf_dir)
    assert batch.count() == stream.count() and batch.exceptAll(stream).count() == 0


def test_queries_without_sql_return_rows(spark, sf_dir):
    expected = {"embed_text": 200, "score_table": 200, "demo_predictions": 4, "fit_classifier": 2}
    for name, n in expected.items():
        assert QUERIES[name](spark, sf_dir).count() == n
