"""From raw documents to packed training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and reads it back as the next stage's input. All stages but the last
return the columns of the documents.

Every stage has the defined results of its operator: null and empty texts are scored, packed and deduplicated like
any other text, rows without an id stay rows of their own, of rows that are equal in id and text line dedup keeps both
and near-dedup one, an empty table passes through as an empty one, and further columns travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levelwise.llm.common import read, stage
from levelwise.llm.decontaminate import clean_documents
from levelwise.llm.line_dedup import without_repeated_lines
from levelwise.llm.packing import pack, tokenizer_file
from levelwise.llm.quality import good_documents
from levelwise.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, accepts."""
    return good_documents(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of three-word shingles are linked by two bits or fewer."""
    return keep_one_of_each(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

# A fitted classifier, SimHash and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
