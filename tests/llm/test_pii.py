"""Personal data against plain patterns and against all segmentations written out."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from levelwise.llm import pii
from levelwise.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if checks(k, m.group())]


def texts(seed, count=400):
    chance = random.Random(seed)
    parts = ["4111111111111111", "192.168.0.1", "+1 (664) 555-5990", "a.b@c.d", "@", ".", "..", "-", " ", "  ", "+", "(", ")", "1", "22", "256", "000",
             "x", "é", "_", "%", "\n", "4 1", "5500-0000-0000-0004", "+4", "0.0.0.0.0.0.0.0", "a@b", "@c.d-e"]
    for _ in range(count):
        yield "".join(chance.choice(parts) for _ in range(chance.randint(1, 14)))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_patterns(seed):
    for text in texts(seed):
        assert pii.pattern_spans(text)[0] == plain(text), text


@pytest.mark.parametrize("seed", range(2))
def test_regions_are_runs_of_chunks_with_a_trigger(seed):
    for text in texts(seed):
        expected, last = [], None
        for chunk in re.finditer(r"\S+", text):
            if re.search("[0-9@]", chunk.group()):
                if last is not None and expected and expected[-1][1] == last:
                    expected[-1] = (expected[-1][0], chunk.end())
                else:
                    expected.append((chunk.start(), chunk.end()))
                last = chunk.end()
            else:
                last = None
        assert list(pii.region_bounds(text)) == expected, repr(text)


def segmentations(length, segments, kinds):
    """All ways to cut 0..length into outside tokens and (segment number, kind)."""
    by_start = {}
    for n, (i, j) in enumerate(segments):
        by_start.setdefault(i, []).append((j + 1, n))

    def walk(place):
        if place == length:
            yield []
            return
        for rest in walk(place + 1):
            yield [(0, None), *rest]
        for end, n in by_start.get(place, []):
            for kind in range(1, kinds):
                for rest in walk(end):
                    yield [(kind, n), *rest]

    return walk(0)


def test_expectations_equal_all_segmentations():
    chance = np.random.default_rng(4)
    length, kinds = 4, len(pii.KINDS) + 1
    segments = [(0, 0), (0, 2), (1, 2), (2, 3), (3, 3)]
    ends = [[(i, n) for n, (i, e) in enumerate(segments) if e == j] for j in range(length)]
    scores, moves = chance.standard_normal((2, len(segments), kinds - 1)), chance.standard_normal((kinds, kinds))
    total, share, moved = pii.expectations(length, ends, scores, moves)
    for b in range(2):
        z, s, m = 0.0, np.zeros((len(segments), kinds - 1)), np.zeros((kinds, kinds))
        for way in segmentations(length, segments, kinds):
            states = [0] + [k for k, _ in way]
            weight = np.exp(sum(moves[a, c] for a, c in itertools.pairwise(states)) + sum(scores[b, n, k - 1] for k, n in way if k))
            z += weight
            for k, n in way:
                if k:
                    s[n, k - 1] += weight
            for a, c in itertools.pairwise(states):
                m[a, c] += weight
        assert np.isclose(total[b], np.log(z)) and np.allclose(share[b], s / z) and np.allclose(moved[b], m / z)


@pytest.mark.parametrize("text", ["+1 22 3", "1.2 3", "a@b.c", "12"])
def test_decoding_finds_the_best_segmentation(text):
    chance = np.random.default_rng(len(text))
    lattice = pii.Lattice(text, "", "")
    own = lattice.segments()
    names = sorted({n for *_, features in own for n in features})
    model = pii.Field({n: i for i, n in enumerate(names)}, chance.standard_normal((len(names), 4)), chance.standard_normal((5, 5)))
    score = [model.score(features) for *_, features in own]

    def value(way):
        return sum(model.moves[a, c] for a, c in itertools.pairwise([0] + [k for k, _ in way])) + sum(score[n][k - 1] for k, n in way if k)

    best = max(segmentations(lattice.length, [(i, j) for i, j, _ in own], 5), key=value)
    expected = [(pii.KINDS[k - 1], lattice.starts[own[n][0]], lattice.ends[own[n][1]]) for k, n in best if k]
    assert model.decode(lattice) == expected


def sentences(count=120):
    chance = random.Random(1)
    for i in range(count):
        digits = [chance.randint(0, 9) for _ in range(15)]
        total = sum(d if p % 2 else sum(divmod(2 * d, 10)) for p, d in enumerate(digits))
        card = "".join(map(str, digits)) + str(-total % 10)
        phone = f"+1 ({chance.randint(100, 999)}) 555-{chance.randint(1000, 9999)}"
        ip = ".".join(str(chance.randint(0, 255)) for _ in range(4))
        yield i, chance.choice([
            f"please pay with {card} today", f"call {phone}, thanks", f"host {ip} is up", f"write to user{i}.x@mail{i}.example.com soon",
            f"order {chance.randint(1, 10**6)} of lot {chance.randint(1, 99)}", f"id 7{chance.randint(10**14, 10**15 - 1)} here",
        ])


def test_the_field_adds_what_a_pattern_swallowed(docs):
    text = "see +1 (578) 555-6437 4918187128635271 there"
    assert plain(text) == []
    found = pii.personal_data(docs(*sentences(), (1000, text), (1001, "nothing but 12 eggs"), (1002, None))).collect()
    by = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] for r in found if r["doc_id"] >= 1000}
    assert by == {1000: [("card", "4918187128635271"), ("phone", "+1 (578) 555-6437")], 1001: [], 1002: []}
    originals = dict(sentences())
    for r in found:
        if r["doc_id"] < 1000:
            spans = [tuple(s) for s in r["spans"]]
            assert [tuple(s) for s in r["base"]] == plain(originals[r["doc_id"]]) and spans == plain(originals[r["doc_id"]])


def test_registered_query_equals_the_patterns(spark, sf_dir):
    originals = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_pii"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(originals)
    for r in got:
        base = plain(originals[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        own = r["spans"].split(",") if r["spans"] else []
        assert set(line.split(",") if line else []) <= set(own) and r["n_spans"] == len(own)
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (o.split(":") for o in own)]
        assert order == sorted(order)


def test_awkward_documents_keep_their_rows(awkward, docs):
    got = pii.personal_data(awkward).collect()
    assert len(got) == awkward.count()
    assert pii.personal_data(docs()).collect() == []


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000, ".@a" * 60_000 + "b" * 200_000])
def test_long_texts_take_linear_time(text):
    spans, failed = pii.pattern_spans(text)
    assert spans == [] or text.startswith("1.")
    assert sum(1 for _ in pii.regions_of(text, spans, failed)) <= 1
