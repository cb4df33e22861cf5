import pytest
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS, attach_level_info, encode_labels, id_to_label, label_to_id, levels_dim
from levelwise.functions.measures import confidence_band, fixed_decimals, pct_of_total, signed_diff
from levelwise.functions.text import clean_text, is_blank, text_preview, words


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_labels_round_trip(spark):
    df = spark.createDataFrame([(level,) for level in LEVELS], "label string")
    rows = df.select("label", label_to_id("label").alias("i"), id_to_label(label_to_id("label")).alias("back")).collect()
    assert [(r.i, r.back) for r in rows] == list(enumerate(LEVELS))


@pytest.mark.parametrize("bad", ["ZZ", "a1", "", None])
def test_unknown_label_fails_and_names_it(spark, bad):
    df = spark.createDataFrame([("A1",), (bad,)], "label string")
    with pytest.raises(Exception, match="unknown label: " + (bad if bad is not None else "NULL")):
        encode_labels(df).collect()


def test_unknown_label_can_be_dropped(spark):
    df = spark.createDataFrame([("A1",), ("ZZ",), (None,), ("C2",)], "label string")
    assert [r.label_id for r in encode_labels(df, on_unknown="drop").collect()] == [0, 5]


def test_bad_mode_is_refused(spark):
    with pytest.raises(ValueError):
        encode_labels(spark.createDataFrame([("A1",)], "label string"), on_unknown="null")


def test_custom_levels(spark):
    df = spark.createDataFrame([("0",), ("1",)], "label string")
    assert [r.label_id for r in encode_labels(df, levels=("0", "1")).collect()] == [0, 1]


def test_level_info(spark):
    assert levels_dim(spark).count() == 6
    row = attach_level_info(spark.createDataFrame([("B2",)], "cefr string")).first()
    assert row["name"] == "Upper Intermediate"


SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_clean_text_strips_what_python_strips(spark):
    cases = [f"{s}a{s}b{s}{s}" for s in SPACES] + ["", " ", "  x", "x \n", " 　", "a  b", "​x"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: (r.c, r.b) for r in df.select("i", clean_text("t").alias("c"), is_blank("t").alias("b")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == (case.strip(), not case.strip())


def test_null_is_blank(spark):
    assert one(spark, is_blank(F.lit(None).cast("string"))) is True


@pytest.mark.parametrize("n, expected", [(0, 0), (99, 99), (100, 100), (101, 103), (150, 103)])
def test_preview_length(spark, n, expected):
    for char in ("x", "é", "\U0001f600"):
        got = one(spark, text_preview(F.lit(char * n)))
        assert len(got) == expected
        assert got == (char * n if n <= 100 else char * 100 + "...")


def test_words_cover_the_whole_text(spark):
    text = "Start " + "mid " * 30000 + "END"
    got = one(spark, words(F.lit(text)))
    assert len(got) == 30002 and got[0] == "start" and got[-1] == "end"


@pytest.mark.parametrize("value, band", [(0.81, "high"), (0.8, "medium"), (0.61, "medium"), (0.6, "low"), (0.0, "low")])
def test_bands(spark, value, band):
    assert one(spark, confidence_band(F.lit(value))) == band


def test_display_helpers(spark):
    assert one(spark, signed_diff(F.lit(5), F.lit(3))) == "+2"
    assert one(spark, signed_diff(F.lit(3), F.lit(5))) == "-2"
    assert one(spark, signed_diff(F.lit(3), F.lit(3))) == "0"
    assert one(spark, pct_of_total(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, pct_of_total(F.lit(0), F.lit(0))) is None
    assert one(spark, fixed_decimals(F.lit(0.5))) == "0.5000"


def test_words_keep_every_script(spark):
    text = "größer niño 2024 Привет café, cafe\u0301 日本_語 a-b x² İ"
    assert one(spark, words(F.lit(text))) == [
        "größer", "niño", "2024", "привет", "café", "cafe\u0301", "日本", "語", "a", "b", "x²", "i̇"]
    assert one(spark, words(F.lit(text), fold=True)) == [
        "großer", "nino", "2024", "привет", "cafe", "cafe", "日本", "語", "a", "b", "x²", "i"]
    assert one(spark, words(F.lit(""))) == [] and one(spark, words(F.lit(None).cast("string"))) is None
