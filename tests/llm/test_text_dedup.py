"""Suffix-array dedup, line dedup and SimHash against plain versions."""

import random

import numpy as np
import pytest

import brute
from conftest import AWKWARD
from levelwise.llm import line_dedup, simhash, suffix_dedup

rng = random.Random(3)
letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))


def suffix_cases() -> list[str]:
    passage, other = letters(900), letters(450)
    texts = [letters(n) for n in (0, 1, 399, 400, 1200)]
    texts += [letters(300) + passage + letters(200), passage[:700] + letters(500), letters(77) + passage[250:] + letters(5)]
    texts += [passage[i : i + 420 + i] + letters(40 + i) for i in range(0, 300, 23)]  # overlaps of all lengths
    texts += ["x" * 400, "y" * 401, "z" * 2500, "ab" * 700, "abc" * 150 + letters(30), other + other, other]
    texts += [letters(50) + "é" * 300 + letters(20), "é" * 260]
    return texts


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_bytes_match_brute_force(docs, hot):
    texts = suffix_cases()
    found = suffix_dedup.remove_repeats(docs(*enumerate(texts)), hot_runs=hot).collect()
    expected = brute.repeats([t.encode() for t in texts], 400)
    assert {r._did: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == dict(enumerate(expected))


def passage_cases() -> list[str]:
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    short, passage = own(50), own(70)
    cut = " ".join(passage.split()[:51])
    texts = [own(30), own(51), own(300), f"{own(20)} {short} {own(20)}", f"{own(9)} {short}", f"{own(40)}\n{passage}, {own(7)}"]
    texts += [f"{own(4)}: {passage.upper().replace(' ', ' - ')}", f"{own(99)} «{cut}» {own(3)}", f"{cut}. {own(60)}", own(50) + " é ü" + own(9)]
    return [*texts, "a b " * 60, "a " * 51, "a " * 52, "", " ,.- "]


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_passages_match_brute_force(docs, hot):
    texts = passage_cases()
    found = suffix_dedup.repeated_words(docs(*enumerate(texts)), hot_runs=hot).collect()
    assert {r._did: r.n_repeated_words for r in found} == {i: n for i, n in enumerate(brute.repeated_words(texts, 51)) if n}
    assert max(len(t.split()) for t in texts) > 51 and len(found) > 5


def test_registered_suffix_query(spark, tmp_path, docs):
    texts = suffix_cases() + passage_cases()
    docs(*enumerate(texts)).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()
    expected, words = brute.repeats([t.encode() for t in texts], 400), brute.repeated_words(texts, 51)
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: (*e, w) for i, (e, w) in enumerate(zip(expected, words))}
    assert len(rows) == len(texts)


def test_long_texts_are_cut_into_blocks_without_loss(monkeypatch):
    data = (letters(5000) + "q" * 1000 + letters(3000)).encode()
    whole = list(suffix_dedup.blocks([data], 400))
    assert len(whole) == 1
    pieces = list(suffix_dedup.blocks([data, b"", data], 400, size=700))
    windows = sum(int(np.maximum(np.diff(ends, prepend=0) - 399, 0).sum()) for _, ends, _, _ in pieces)
    assert windows == 2 * (len(data) - 399)


def test_suffix_index_keeps_few_levels(spark, docs):
    runs = suffix_dedup.text_runs(docs(*enumerate(letters(600) for _ in range(8))))
    index = suffix_dedup.SuffixIndex(spark)
    for n in range(7):
        index.add(runs.filter(f"_did = {n}"))
    assert [rank for rank, _, _ in index.levels] == [2, 1, 0]
    assert index.add(runs.filter("_did = 3")).count() == runs.filter("_did = 3").select("gram").distinct().count()
    assert [rank for rank, _, _ in index.levels] == [3]
    index.close()


def test_suffix_dedup_awkward_rows(awkward, docs):
    rows = suffix_dedup.remove_repeats(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r._did: r for r in rows}
    assert by_id[7].n_removed == by_id[7].n_bytes and by_id[7].kept_sha256 == brute.sha("")
    assert by_id[1].n_bytes == 0 and by_id[5].n_removed == 0
    assert suffix_dedup.remove_repeats(docs()).count() == 0
    passages = {(r._did, r.n_repeated_words) for r in suffix_dedup.repeated_words(awkward).collect()}
    assert passages == {(7, 30_000), (8, 30_000)}
    assert suffix_dedup.repeated_words(docs()).count() == 0


def test_lines_match_brute_force(docs):
    pool = [" Shared line number %d\t" % i for i in range(6)] + ["short", "", "ÄRGERLICHE ZEILE", "ärgerliche zeile", "Ärgerliche ZEILE\r"]
    rows = [(i % 40, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [r for r in AWKWARD if r[0] is not None]
    found = line_dedup.dedup_lines(docs(*rows)).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect()
    expected = brute.kept_lines(rows)
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in found) == sorted(expected[r] for r in rows)


def test_line_dedup_awkward_rows(awkward, docs):
    rows = line_dedup.dedup_lines(awkward).select("row.doc_id", "row.text", "kept", "n_dropped").collect()
    assert len(rows) == len(AWKWARD)
    assert [r.kept for r in rows if r.doc_id == 5] == ["same text in two documents, long enough"]
    assert all(r.n_dropped == 1 for r in rows if r.doc_id == 6 and r.text.startswith("same"))
    assert line_dedup.without_repeated_lines(awkward).columns == awkward.columns
    assert line_dedup.dedup_lines(docs()).count() == 0


def test_a_line_in_all_documents_stays_once(docs):
    rows = [(i, f"the line everybody has\nown {i} text") for i in range(300)]
    kept = line_dedup.without_repeated_lines(docs(*rows)).filter("text LIKE '%everybody%'")
    assert [r.doc_id for r in kept.collect()] == [0]


def near_copies() -> list[tuple[int, str]]:
    base = [" ".join(letters(4) for _ in range(80)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base * 2)]
    for i in range(100):
        w = base[i % 5].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, "Two words"), (5003, "two  WORDS"), (5004, "é É")]


def test_components_match_brute_force(docs):
    rows = near_copies()
    found = simhash.near_components(docs(*rows)).collect()
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    assert {r._did: r.fp % 2**64 for r in found} == dict(prints)
    assert {r._did: r.component for r in found} == brute.components(prints)
    assert len({r.component for r in found}) < len(rows)


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 8])
def test_links_of_any_radius_are_whole(spark, radius):
    g = np.random.default_rng(radius)
    base = g.integers(0, 2**63, 12).astype("uint64")
    flips = [base ^ np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, (n, 12)).astype("uint64"), axis=0) for n in range(1, 12)]
    fps = np.unique(np.concatenate([base, *flips]))
    nodes = spark.createDataFrame([(int(v),) for v in fps.view("int64")], "fp long")
    found = simhash.min_labels(simhash.fingerprint_links(nodes, radius)).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    signed, label = fps.view("int64"), np.arange(len(fps))
    for a, b in np.argwhere(near):
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    groups = {}
    for i, own in enumerate(label):
        groups.setdefault(own, []).append(int(signed[i]))
    expected = {v: min(own) for own in groups.values() if len(own) > 1 for v in own}
    assert {r.v: r.label for r in found} == expected


def test_radius_beyond_the_blocks_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.blocks(9)


def test_bk_forest_finds_every_pair_within_the_radius():
    g = np.random.default_rng(4)
    fp = np.unique((g.integers(0, 2**63, 40).astype("uint64")[:, None] ^ (np.uint64(1) << g.integers(0, 64, (40, 30)).astype("uint64"))).ravel().view("int64"))
    shard = np.sort(g.integers(0, 3, len(fp)))
    for radius in (0, 2, 5):
        pairs = set()
        for a, b in simhash.BkForest(shard, fp).links(radius):
            pairs |= set(zip(a.tolist(), b.tolist()))
        bits = fp.view("uint64")
        near = (np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius) & (shard[:, None] == shard[None, :])
        np.fill_diagonal(near, False)
        assert pairs == set(map(tuple, np.argwhere(near).tolist()))


def test_chains_of_links_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90)], "a long, b long")
    labels = {r.v: r.label for r in simhash.min_labels(links).collect()}
    assert labels == {**dict.fromkeys(range(61), 0), 90: 90, 100: 90}


def test_near_dedup_awkward_rows(awkward, docs):
    assert simhash.near_components(awkward).count() == len(AWKWARD)
    kept = simhash.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 9), (True, 0)]
    assert simhash.near_components(docs()).count() == 0
