import pytest
from pyspark.sql import functions as F

from levelwise.operators.requests import filter_blank, request_status, requests_explode, score_requests
from levelwise.operators.score import score_linear
from levelwise.sources.exchange import read_requests, request_payloads, write_predictions
from levelwise.sources.labelled import DatasetNotFound, null_text_count, prepare_labelled, read_labelled
from levelwise.sources.staging import stage, staging_root
from levelwise.streaming.score_stream import request_stream, score_stream

REQUESTS = [
    (1, ["  I like cats. ", "", "\t\n", " ", "　", "Two  words"]),
    (2, []),
    (3, ["", "   ", None]),
    (4, ["one"]),
    (5, None),
]


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(REQUESTS, "request_id long, sentences array<string>")


def length_scorer(rows):
    features = F.array(F.length("sentence").cast("double"))
    return score_linear(rows.withColumn("features", features), [[-1.0], [0.0], [1.0], [0.1], [0.2], [0.3]])


def test_status(requests):
    got = {r["request_id"]: r["status"] for r in request_status(requests).collect()}
    assert got == {1: "ok", 2: "no_sentences", 3: "no_valid_sentences", 4: "ok", 5: "no_sentences"}


def test_explode_keeps_order_and_filter_drops_blanks(requests):
    rows = requests_explode(requests)
    assert [r["pos"] for r in rows.where("request_id = 1").collect()] == list(range(6))
    kept = filter_blank(rows).orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["pos"]) for r in kept] == [(1, 0), (1, 5), (4, 0)]


def test_score_requests(requests):
    rows = score_requests(requests, length_scorer, ordered=True).collect()
    assert [(r["request_id"], r["pos"], r["sentence"], r["status"]) for r in rows] == [
        (1, 0, "I like cats.", "ok"), (1, 5, "Two  words", "ok"), (2, None, None, "no_sentences"),
        (3, None, None, "no_valid_sentences"), (4, 0, "one", "ok"), (5, None, None, "no_sentences")]
    assert all(r["cefr"] == "B1" and 1 / 6 <= r["confidence"] <= 1 for r in rows if r["status"] == "ok")
    assert all(r["cefr"] is None and r["confidence"] is None for r in rows if r["status"] != "ok")


def test_empty_input_gives_empty_output(requests):
    assert score_requests(requests.where("request_id = 9"), length_scorer).count() == 0


LINES = ['{"request_id": 1, "sentences": ["one", " "]}', '{"request_id": "a-7", "sentences": ["two"]}', "{broken", "not json",
         '{"request_id": 3, "sentences": "no list"}', '{"request_id": 4}', "", "   ", '{"sentences": ["no id"]}', "[1]"]


def test_every_line_is_answered(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(LINES))
    rows = score_requests(read_requests(spark, f"{tmp_path}/in.jsonl"), length_scorer).collect()
    got = sorted((str(r["request_id"]), str(r["sentence"]), r["status"], str(r["raw"])) for r in rows)
    assert [g for g in got if g[2] != "malformed"] == sorted([
        ("1", "one", "ok", "None"), ("a-7", "two", "ok", "None"), ("4", "None", "no_sentences", "None"), ("None", "no id", "ok", "None")])
    assert sorted(g[3] for g in got if g[2] == "malformed") == sorted([LINES[2], LINES[3], LINES[4], LINES[9]])


def test_stream_equals_batch(spark, requests, tmp_path):
    bad = spark.createDataFrame([(line,) for line in LINES], "value string")
    request_payloads(requests).union(bad).repartition(3).write.text(f"{tmp_path}/in")
    stream = request_stream(spark, f"{tmp_path}/in", max_files=1)
    assert stream.isStreaming
    for _ in range(2):  # the second run finds nothing new
        score_stream(stream, length_scorer, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    batch = score_requests(read_requests(spark, f"{tmp_path}/in"), length_scorer)
    streamed = spark.read.parquet(f"{tmp_path}/out")
    assert streamed.count() == batch.count() == 6 + 8
    assert streamed.exceptAll(batch).count() == 0


def test_predictions_sink(spark, requests, tmp_path):
    scored = score_requests(requests, length_scorer)
    for fmt in ("parquet", "json"):
        write_predictions(scored, f"{tmp_path}/{fmt}", fmt, keep=("request_id",))
        back = spark.read.format(fmt).load(f"{tmp_path}/{fmt}")
        assert sorted(back.columns) == ["cefr", "confidence", "request_id", "sentence"]
        assert back.count() == 3


CSV = 'label,extra,text\nA1,x,"one, two"\nB2,y,"line 1\nline 2"\nC2,z,"say ""hi"""\nA2,w,NA\nB1,v,\n'


def test_csv_by_name_with_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(CSV)
    df = read_labelled(spark, str(path))
    assert df.columns == ["id", "text", "label"]
    rows = df.orderBy("id").collect()
    assert [r["text"] for r in rows] == ["one, two", "line 1\nline 2", 'say "hi"', "NA", None]
    assert len({r["id"] for r in rows}) == 5
    assert read_labelled(spark, str(path), na_values=("NA",)).where("text is null").count() == 2


def test_null_text_is_dropped_and_counted_or_kept(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(CSV)
    loaded = read_labelled(spark, str(path))
    df = prepare_labelled(loaded)
    assert sorted(r["label_id"] for r in df.collect()) == [0, 1, 3, 5]
    assert tuple(null_text_count(loaded).first()) == (5, 1)
    kept = prepare_labelled(read_labelled(spark, str(path)), null_text="nan")
    assert kept.where("text = 'nan'").count() == 1
    with pytest.raises(ValueError):
        prepare_labelled(df, null_text="keep")


def test_parquet_and_missing_data(spark, tmp_path):
    spark.createDataFrame([(7, "t", "A1")], "id long, text string, label string").write.parquet(f"{tmp_path}/d.parquet")
    assert tuple(read_labelled(spark, f"{tmp_path}/d.parquet").first()) == (7, "t", "A1")
    with pytest.raises(DatasetNotFound, match="labelled data not found"):
        read_labelled(spark, f"{tmp_path}/none.csv")
    with pytest.raises(ValueError, match="no column"):
        read_labelled(spark, f"{tmp_path}/d.parquet", label="level")
    spark.read.parquet(f"{tmp_path}/d.parquet").write.parquet(f"{tmp_path}/folder")
    with pytest.raises(ValueError, match="pass fmt"):
        read_labelled(spark, f"{tmp_path}/folder")
    assert read_labelled(spark, f"{tmp_path}/folder", fmt="parquet").count() == 1


def test_staging_uses_the_shared_folder(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    staged = stage(df, "numbers")
    assert staged.dtypes == df.dtypes and staged.exceptAll(df).count() == 0
    assert all(staging_root(spark) in f for f in staged.inputFiles())
