"""Every stage of the pipeline against a plain version, on its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from conftest import AWKWARD
from levelwise.llm import packing, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        step(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_all_but_the_last_return_documents(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality_stage(spark, sf_dir, stages):
    before, after = stages[0]
    model = quality.fit_ranker(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = before.collect()
    m = np.array([quality.measures((r.text or "").encode()) for r in rows])
    expected = {r.doc_id for r, s in zip(rows, model.scores(m)) if s >= 0.5}
    assert {r.doc_id for r in after.collect()} == expected and len(expected) < len(rows)


def test_line_stage(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    expected = {i: kept for (i, _), (_, _, kept) in brute.kept_lines(rows).items()}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copy_stage(stages):
    before, after = stages[2]
    label = brute.components([(r.doc_id, brute.fingerprint(r.text)) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, c in label.items() if i == c}


def test_benchmark_stage(spark, sf_dir, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = {r.doc_id for r in before.collect() if not brute.hits(r.text, items)[1]}
    assert {r.doc_id for r in after.collect()} == expected


def test_packing_stage(stages):
    before, after = stages[4]
    plain = Tokenizer.from_file(packing.tokenizer_file())
    expected = []
    for r in before.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected += [(r.doc_id, at, zlib.crc32(np.asarray(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in after.collect()) == sorted(expected)


def test_run_gives_the_rows_of_the_stages(spark, sf_dir, stages):
    rows = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages[-1][1])


def test_awkward_documents_pass_through(spark, sf_dir, awkward):
    docs = awkward
    for _, step in corpus_pipeline.STAGES[1:]:
        docs = step(spark, docs, sf_dir)
    assert 0 < docs.count() <= len(AWKWARD) + 40
