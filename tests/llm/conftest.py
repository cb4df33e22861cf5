import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, score double, row string, kept string, _did long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with further columns whose names the operators use themselves."""

    def build(*rows):
        return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)

    return build


LONG = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
AWKWARD = [
    (None, None), (None, "some words without an id"), (1, None), (2, ""), (3, " \t\n\r\n "), (4, "ÄÖ ß İ   x"),
    (5, "same text in two documents, long enough"), (6, "same text in two documents, long enough"),
    (6, "same text in two documents, long enough"), (6, "another text of the same document id"), (7, LONG), (8, LONG), (9, "a"),
]


@pytest.fixture
def awkward(docs):
    return docs(*AWKWARD)
