"""Scoring requests: arrays of sentences in, one scored row per sentence or one outcome per refused request out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.text import clean_text, is_blank
from levelwise.sources.exchange import RAW

# Request outcomes.
OK, MALFORMED, NO_SENTENCES, NO_VALID_SENTENCES = "ok", "malformed", "no_sentences", "no_valid_sentences"


def requests_explode(requests: DataFrame, keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """One row per sentence with its position in the request."""
    return requests.select(*keep, F.posexplode("sentences").alias("pos", "sentence"))


def request_status(requests: DataFrame) -> DataFrame:
    """Outcome of each request, decided inside its row; a kept ``raw`` line marks a malformed one."""
    count = F.coalesce(F.size("sentences"), F.lit(0))
    valid = F.coalesce(F.size(F.filter("sentences", lambda s: ~is_blank(s))), F.lit(0))
    status = (
        F.when(_raw(requests).isNotNull(), F.lit(MALFORMED))
        .when(count <= 0, F.lit(NO_SENTENCES))
        .when(valid <= 0, F.lit(NO_VALID_SENTENCES))
        .otherwise(F.lit(OK))
    )
    return requests.withColumn("status", status)


def filter_blank(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Drop rows whose text is NULL, empty or whitespace."""
    return df.where(~is_blank(text))


def score_requests(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], ordered: bool = False
) -> DataFrame:
    """One scored row per valid sentence, and one row for each request that is refused.

    ``score`` maps a frame with a ``sentence`` column to the same rows plus
    ``cefr`` and ``confidence``. ``status`` tells the outcome; refused requests
    have no position, sentence or score, malformed ones keep their line in
    ``raw``. Everything is row-wise and reads the requests once, so the same
    function serves a table and a stream; ``ordered`` adds the one sort, for an
    export.
    """
    cleaned = F.transform("sentences", lambda s, i: F.struct(i.alias("pos"), clean_text(s).alias("sentence")))
    valid = F.filter(cleaned, lambda s: s["sentence"] != "")
    answered = F.col("status") == OK
    rows = request_status(requests).withColumn(RAW, _raw(requests)).select(
        "request_id", "status", RAW, F.explode_outer(F.when(answered, valid)).alias("_s")
    )
    # The scorer always gets a text; what it says about a refused request is dropped.
    filled = rows.select("request_id", "status", RAW, "_s.pos", F.coalesce("_s.sentence", F.lit("")).alias("sentence"))
    outcome = [F.when(answered, F.col(c)).alias(c) for c in ("sentence", "cefr", "confidence")]
    scored = score(filled).select("request_id", "pos", *outcome, "status", RAW)
    return scored.orderBy("request_id", "pos") if ordered else scored


def _raw(requests: DataFrame) -> Column:
    return F.col(RAW) if RAW in requests.columns else F.lit(None).cast("string")
