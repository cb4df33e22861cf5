"""Sources in splits, sinks and evaluations of streams, and fits that go on after a stop."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.ml.classification import LogisticRegression

from levelwise.catalog import streams
from levelwise.operators.metrics import confusion_cells, evaluate_table
from levelwise.plans import fit as ft
from levelwise.sources.labelled import prepare_labelled, read_labelled
from levelwise.sources.records import csv_records, open_splits, read_split_csv, split_lines
from levelwise.streaming import evaluate_stream as es
from levelwise.streaming.prediction_sink import keyed_writer, sink_predictions


def awkward_csv(folder, seed, rows=120):
    """A file with quotes, doubled quotes, commas and newlines of both kinds inside fields."""
    chance = random.Random(seed)
    parts = ['"', "\n", ",", "a", "word ", "é", "\r\n", "\n\n", '""', "tail "]
    lines = ["id,text,label"]
    for i in range(rows):
        text = "x" + "".join(chance.choice(parts) for _ in range(chance.randint(0, 30))) + "y"
        quoted = '"' + text.replace('"', '""') + '"'
        lines.append(f"{i},{quoted},{chance.choice(['A1', 'C2'])}")
        if i % 17 == 0:
            lines.append("")
    folder.mkdir()
    with open(folder / f"part-{seed}.csv", "w", newline="", encoding="utf-8") as f:
        f.write("\n".join(lines) + ("\n" if seed % 2 else ""))
    return str(folder)


@pytest.fixture
def small_splits(spark):
    def limit(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield limit
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("seed, size", [(1, 10_000_000), (1, 700), (2, 64), (3, 150), (4, 9)])
def test_splits_give_the_rows_of_one_task(spark, tmp_path, small_splits, seed, size):
    folder = awkward_csv(tmp_path / "csv", seed, rows=12 if size < 100 else 120)
    expected = sorted(map(tuple, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder).collect()))
    small_splits(size)
    if size < 10_000:
        assert split_lines(spark, folder).select("block").distinct().count() >= 8
        assert open_splits(split_lines(spark, folder)).count() > 0
    got = read_split_csv(spark, folder)
    assert got.columns == ["id", "text", "label"]
    assert sorted(map(tuple, got.collect())) == expected
    assert csv_records(spark, folder).where("first").count() == 1


def test_split_reading_of_labelled_files(spark, tmp_path, small_splits):
    folder = awkward_csv(tmp_path / "csv", 7)
    whole = prepare_labelled(read_labelled(spark, folder, fmt="csv")).collect()
    small_splits(300)
    split = prepare_labelled(read_labelled(spark, folder, fmt="csv", multi_line="split")).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole)) and len(split) == 120


def test_a_header_alone_and_several_files(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("text,label\n")
    assert read_split_csv(spark, str(folder)).collect() == []
    (folder / "b.csv").write_text('text,label\n"two\nlines",A1\nplain,B2')
    assert sorted(map(tuple, read_split_csv(spark, str(folder)).collect())) == [("plain", "B2"), ("two\nlines", "A1")]


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    schema = "request_id string, pos int, sentence string, cefr string, confidence double, status string"
    rows = [[("a", 0, "s", "A1", 0.5, "ok"), ("b", None, None, None, None, "no_sentences")], [("c", 1, "t", "B1", 0.25, "ok")]]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, own in enumerate(rows):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sink_predictions(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    first = sorted(map(tuple, spark.read.parquet(out).select("request_id", "pos", "cefr", "batch_id").collect()))
    assert [r[:3] for r in first] == [("a", 0, "A1"), ("c", 1, "B1")] and {r[3] for r in first} == {0, 1}
    # The first batch runs again, as after a crash between its write and its commit.
    again = next(r[3] for r in first if r[0] == "a")
    from levelwise.sources.exchange import prediction_records

    keyed_writer(out, lambda r: prediction_records(r, ("request_id", "pos")))(spark.createDataFrame(rows[0], schema), again)
    assert sorted(map(tuple, spark.read.parquet(out).select("request_id", "pos", "cefr", "batch_id").collect())) == first


def test_stream_evaluation_equals_the_table(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    chance = random.Random(2)
    shown = [(i, chance.randint(0, 5), start + dt.timedelta(hours=i)) for i in range(90)]
    known = [(i, chance.randint(0, 5), start + dt.timedelta(hours=i + chance.choice([0, 3, 24, 40]))) for i in range(0, 90, 2)]
    known += [(None, 1, start), (500, 1, start)]
    paths = [str(tmp_path / n) for n in ("shown", "known")]
    # Three files each, in the order of time: three micro-batches.
    for path, rows, schema in zip(paths, (shown, sorted(known, key=lambda r: r[2])), ("id long, p int, at timestamp", "id long, y int, at timestamp")):
        for i in range(3):
            own = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
    read = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p) for p, s in zip(paths, ("id long, p int, at timestamp", "id long, y int, at timestamp"))]
    out = str(tmp_path / "cells")
    es.evaluate_stream(*read, out, str(tmp_path / "checkpoint"), late="1 days", disorder="50 hours").awaitTermination()
    table = es.matched(spark.createDataFrame(shown, "id long, p int, at timestamp"), spark.createDataFrame(known, "id long, y int, at timestamp"), "1 days")
    expected = evaluate_table(confusion_cells(table)).first()
    plain = {i: (p, at) for i, p, at in shown}
    pairs = [(y, plain[i][0]) for i, y, at in known if i in plain and plain[i][1] <= at <= plain[i][1] + dt.timedelta(days=1)]
    got = es.stream_evaluation(spark, out).first()
    assert got["n"] == expected["n"] == len(pairs) and got["accuracy"] == pytest.approx(sum(y == p for y, p in pairs) / len(pairs))
    assert got["macro_f1"] == pytest.approx(expected["macro_f1"])


CANDIDATES = ({"regParam": 0.1, "maxIter": 3}, {"regParam": 0.01, "maxIter": 3}, {"regParam": 0.001, "maxIter": 3})


@pytest.mark.parametrize("features", ["counts", "embedding"])
def test_a_stopped_fit_goes_on_after_its_last_candidate(spark, tmp_path, monkeypatch, features):
    rows = [(f"{'good fine' if i % 2 else 'bad poor'} text {i % 7}", i % 2, "val" if i % 5 == 0 else "train") for i in range(80)]
    parts = spark.createDataFrame(rows, "text string, label_id int, split string")
    settings = ft.FitSettings(candidates=CANDIDATES, levels=("0", "1"), num_features=64, features=features, dim=4)
    fits, fit = [], LogisticRegression.fit

    def stops_at_the_third(self, *args):
        fits.append(self.getRegParam())
        if len(fits) == 3:
            raise KeyboardInterrupt
        return fit(self, *args)

    monkeypatch.setattr(LogisticRegression, "fit", stops_at_the_third)
    with pytest.raises(KeyboardInterrupt):
        ft.fit_parts(parts, settings, resume=str(tmp_path))
    done = ft.fit_parts(parts, settings, resume=str(tmp_path))
    assert fits == [0.1, 0.01, 0.001, 0.001] and [h[0] for h in done.history] == [1, 2, 3]
    again = ft.fit_parts(parts, settings, resume=str(tmp_path))
    assert len(fits) == 4 and again.history == done.history and again.best == done.best
    # Other rows are another fit.
    ft.fit_parts(parts.where("text not like '%6'"), settings, resume=str(tmp_path))
    assert len(fits) == 7


def test_the_request_log_is_dealt_by_its_size(spark, sf_dir, monkeypatch):
    plain, seen, opened = streams.predictions_stream_sink(spark, sf_dir), [], streams.request_stream

    def watch(session, path, max_files=None):
        seen.append((len(list(Path(path.removeprefix("file:")).glob("part-*"))), max_files))
        return opened(session, path, max_files)

    monkeypatch.setattr(streams, "FILE_BYTES", 50_000, raising=False)
    monkeypatch.setattr(streams, "request_stream", watch)
    dealt = streams.predictions_stream_sink(spark, sf_dir)
    # Three batches at any size; their files grow in number, not in size.
    assert seen[0][1] > 1 and seen[0][0] == 3 * seen[0][1]
    assert dealt.count() == plain.count() > 0 and dealt.exceptAll(plain).count() == 0
