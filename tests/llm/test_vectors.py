"""Whitening and clustering against plain numpy and Python versions."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from compare import differences, oracle_connection
from levelwise.llm import clustering, whitening
from levelwise.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, x long, v string, cluster int"


@pytest.fixture
def vectors(spark):
    return lambda *rows: spark.createDataFrame([(i, e, None, None, None) for i, e in rows], VECTORS)


def plain_whitening(rows, components=16):
    """Rows (id, whole-number vector) -> n, deviations, eigenvalues, axes, trace, by a dense eigensolver."""
    x = np.array([r[1] for r in rows], object)
    distinct = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = np.array((distinct * n - sums).tolist(), "float64") / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    deviations = [sum(int(d) ** 2 for d in n * row - sums) for row in x]
    centred = np.array((x * n - sums).tolist(), "float64") / n
    return n, deviations, values[::-1][:components], axes[:, ::-1][:, :components], values.sum(), centred


def test_registered_whitening_equals_a_dense_solver(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [math.floor(64 * float(c)) + 1_000_000 for c in r["embedding"]]) for r in table]
    n, deviations, values, axes, trace, centred = plain_whitening(rows)
    expected = centred @ axes / np.sqrt(values)
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    assert len(got) == 16 * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = [np.sign(sum(by[i, c + 1]["whitened"] * expected[k, c] for k, (i, _) in enumerate(rows))) for c in range(16)]
    for k, (i, _) in enumerate(rows):
        for c in range(16):
            r = by[i, c + 1]
            assert abs(r["whitened"] - signs[c] * expected[k, c]) < 1e-8
            assert (r["n"], r["deviation"]) == (n, deviations[k])
            assert abs(r["explained"] / (values[c] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert QUERIES["op11_embedding_whitening"](spark, sf_dir).schema.simpleString().startswith(
        "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double")


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts_positive_eigenvalues(seed):
    random = np.random.default_rng(seed)
    for width in (1, 2, 5, 17, 40):
        a = random.standard_normal((width, width))
        a = a + a.T if seed % 2 else a[:, : width // 2 + 1] @ a[:, : width // 2 + 1].T - np.eye(width) / 3
        assert whitening.positive_count(a) == int((np.linalg.eigvalsh(a) > 0).sum())


@pytest.mark.parametrize("spectrum", [
    [5.0] * 20 + [1.0] * 10, list(range(40, 0, -1)), [1 + 1e-7 * i for i in range(30)], [2.0 ** -i for i in range(30)], [3.0], [1.0, 1.0],
])
def test_intervals_find_all_leading_pairs(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum), len(spectrum))))
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2 / sum(spectrum)
    values, axes = whitening.Spectrum(matrix).leading(16)
    expected = np.sort(spectrum)[::-1][:16] / sum(spectrum)
    assert np.allclose(values, expected, rtol=0, atol=1e-13)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ axes, axes * values, atol=1e-12)


def test_whitening_of_awkward_vectors(spark, vectors):
    nan, inf = float("nan"), float("inf")
    rows = vectors(
        (1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, -1.0]), (None, [1.5, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]),
        (6, [None, 1.0]), (7, [0.5]), (8, []),
    )
    got = whitening.whiten(whitening.shifted_vectors(rows)).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 4, 2: 2, None: 2, 7: 2, 8: 2}
    assert {r["n"] for r in got} == {5} and all(r["identity_error"] < 1e-12 for r in got)
    # Beside a huge entry the other component has no variance to speak of.
    huge = whitening.whiten(whitening.shifted_vectors(rows.union(vectors((9, [3e38, 0.0]))))).collect()
    assert Counter(r["vec_id"] for r in huge) == {1: 2, 2: 1, None: 1, 7: 1, 8: 1, 9: 1}
    assert [r["deviation"] for r in huge if r["vec_id"] == 9] == [None]
    one = whitening.whiten(whitening.shifted_vectors(vectors((1, [1.0, 2.0]), (2, [1.0, 2.0]))))
    assert one.collect() == [] and one.columns == [c.split()[0] for c in whitening.WHITENED.split(", ")]
    assert whitening.whiten(whitening.shifted_vectors(vectors())).collect() == []


def test_large_numbers_stay_exact():
    centre = whitening.Centre(10**12, (3 * 10**12 * 10**6, 10**18))
    x = np.array([[3 * 10**6 + 1, 10**6]], "int64")
    assert centre.spread(x).tolist() == [[10**12, 0]]
    assert centre.deviations(x) == [None]
    assert centre.centred(x).tolist() == [[float(Fraction(10**12, 10**12)), 0.0]]


def plain_clusters(rows, k=16, rounds=3, width=64):
    """(id, floats) -> list of (id, cluster, distance, cluster inertia, inertia, centroid hash)."""
    kept = [(i, [math.floor(64 * float(c)) for c in e]) for i, e in rows
            if e is not None and len(e) == width and all(c is not None and math.isfinite(c) for c in e)]
    hashed = sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept))
    centroids = [list(v) for _, _, v in hashed[:k]]
    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(place(v)[1], []).append(v)
        for n, own in members.items():
            centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    placed = [(i, *place(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, c, d in placed:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for i, c, d in placed), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_registered_clustering_equals_its_sql_and_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(QUERIES["op12_centroid_clustering"](spark, sf), oracle_connection(sf), ORACLES["op12_centroid_clustering"]) == []
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    plain = plain_clusters([(r["vec_id"], r["embedding"]) for r in table])
    assert found(QUERIES["op12_centroid_clustering"](spark, "/root/testdata/sf0.001")) == plain


def test_clustering_of_awkward_vectors(spark, vectors):
    nan, inf = float("nan"), float("inf")
    flat = [0.0] * 63
    rows = [(i, [float(i % 3)] + flat) for i in range(6)] + [(0, [0.0] + flat)] * 3 + [
        (None, [2.0] + flat), (None, [1.0] + flat), (20, None), (21, [nan] + flat), (22, [-inf] + flat), (23, [None] + flat), (24, flat), (25, []),
    ]
    run = lambda k, data: clustering.described(*clustering.cluster_vectors(clustering.integer_vectors(vectors(*data)), k))
    for k in (1, 2, 4, 16):
        assert found(run(k, rows)) == plain_clusters(rows, k)
    empty = run(4, [])
    assert empty.collect() == [] and len(empty.columns) == 6
    huge = found(run(2, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [3e38] * 64)]))
    assert len(huge) == 3


def test_pivots_leave_out_centroids_but_never_the_nearest():
    random = np.random.default_rng(5)
    centres = random.integers(-3000, 3000, (16, 64))
    v = np.concatenate([c + random.integers(-40, 40, (60, 64)) for c in centres])
    v[::7] = centres[(np.arange(len(v[::7])) % 16)]
    twins = np.concatenate((centres, centres[:3]))
    pivots = v[random.choice(len(v), 8, replace=False)]
    cluster, distance, exact = clustering.nearest(v, clustering.pivot_distances(v, pivots), twins, clustering.pivot_distances(twins, pivots))
    whole = ((v[:, None, :] - twins[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert exact < 0.3 * whole.size
