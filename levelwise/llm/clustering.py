"""Centroid clustering of whole-number vectors with a LAESA pivot table.

The start vectors serve as pivots. The distance of every vector to every pivot is taken once and stored beside it in
the shared folder. In each round a centroid's distances to the pivots are known on the driver; the largest difference
of two pivot distances bounds the distance of a vector to a centroid from below (triangle inequality). A vector first
meets the centroid of the least bound; centroids whose bound exceeds that exact distance are left out, all others
receive exact integer distances. Bounds carry a margin for rounding, so that ties are always decided exactly.

Tasks send one sum per cluster and component; Spark adds them up. The driver holds centroids only.

Defined results: only vectors of exactly ``width`` components, none null or non-finite, take part; components beyond
2**27 after scaling are held there, so that squared distances fit a long; rows without an id take part but come last
as start vectors; repeated rows count each, as start vectors too, ties of their hash going to the smaller vector; of
equal centroids the first gets all vectors and the others stay as they are; fewer than ``k`` vectors give fewer
clusters; an empty table gives an empty result; sums beyond a long are held at its largest value; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage
from levelwise.llm.maxscore import whole
from levelwise.llm.whitening import as_matrix

SCALE, WIDTH, CLUSTERS, ROUNDS = 64, 64, 16, 3
LIMIT = float(2**27)
# Relative allowance for the rounding of square roots in bounds.
MARGIN = 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: vectors of the right length with finite components, as whole numbers."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: whole(F.greatest(F.least(c.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT)))
    valid = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width) & sound)
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: held(c).cast("long")).alias("v"))


def start_vectors(vectors: DataFrame, k: int = CLUSTERS, salt: str = "1:") -> np.ndarray:
    """The ``k`` vectors whose ids hash least, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], "int64")


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one centroid each."""
    d = v - centroids
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype("float64"))


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, t``: vectors with their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pivot_distances(as_matrix(batch.column("v")), pivots)
                ends = pa.array(np.arange(len(t) + 1) * t.shape[1], pa.int32())
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(t.ravel()))], names=["vec_id", "v", "t"])

    return vectors.select("vec_id", "v").mapInArrow(measure, "vec_id long, v array<long>, t array<double>")


def nearest(v: np.ndarray, t: np.ndarray, centroids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance per row, and how many exact distances that took.

    ``t`` and ``table`` are the distances of rows and centroids to the pivots.
    """
    bound = np.empty((len(v), len(centroids)))
    for c, row in enumerate(table):
        bound[:, c] = (np.abs(t - row) - MARGIN * (t + row)).max(axis=1)
    np.maximum(bound, 0, out=bound)
    cluster = bound.argmin(axis=1)
    distance = squared(v, centroids[cluster])
    first, limit = cluster.copy(), distance * (1 + MARGIN)
    exact = len(v)
    for c in range(len(centroids)):
        at = np.flatnonzero((bound[:, c] ** 2 <= limit) & (first != c))
        if not len(at):
            continue
        exact += len(at)
        d = squared(v[at], centroids[c])
        better = (d < distance[at]) | ((d == distance[at]) & (c < cluster[at]))
        at = at[better]
        cluster[at], distance[at] = c, d[better]
        limit[at] = distance[at] * (1 + MARGIN)
    return cluster, distance, exact


def member_sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, component); component -1 counts members."""
    k, at_pivots = len(centroids), pivot_distances(centroids, pivots)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, centroids.shape[1] + 1), "int64")
        for batch in batches:
            if batch.num_rows:
                v = as_matrix(batch.column("v"))
                cluster = nearest(v, as_matrix(batch.column("t")), centroids, at_pivots)[0]
                for c in np.unique(cluster):
                    own = v[cluster == c]
                    total[c, 0] += len(own)
                    total[c, 1:] += own.sum(axis=0)
        at = np.flatnonzero(total[:, 0])
        if len(at):
            width = total.shape[1]
            columns = [np.repeat(at, width).astype("int32"), np.tile(np.arange(-1, width - 1), len(at)).astype("int32"), total[at].ravel()]
            yield pa.record_batch([pa.array(c) for c in columns], names=["cluster", "at", "total"])

    parts = table.select("v", "t").mapInArrow(sums, "cluster int, at int, total long")
    added = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(c, at): int(total) for c, at, total in added.collect()}


def refine(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Floors of the members' means; a centroid without members stays."""
    sums, moved = member_sums(table, centroids, pivots), centroids.copy()
    for c in range(len(moved)):
        if (c, -1) in sums:
            moved[c] = [sums[c, i] // sums[c, -1] for i in range(moved.shape[1])]
    return moved


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` per vector."""
    at_pivots = pivot_distances(centroids, pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(as_matrix(batch.column("v")), as_matrix(batch.column("t")), centroids, at_pivots)
                yield pa.record_batch([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(near, "vec_id long, cluster int, distance long")


def held(total: Column) -> Column:
    return F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector, staged, and the final centroids."""
    pivots = start_vectors(vectors, k)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), pivots
    table = stage(with_pivots(vectors, pivots), "pivots")
    centroids = pivots
    for _ in range(rounds):
        centroids = refine(table, centroids, pivots)
    return stage(assign(table, centroids, pivots), "clusters"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assigned vectors with the inertia of their cluster and of all, and the hash of their centroid."""
    if not len(centroids):
        return assigned.sparkSession.createDataFrame([], RESULT)
    hashes = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    known = assigned.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = assigned.agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    # One row per cluster and one row in all: the sizes of these sides do not depend on the vectors.
    per = sums.join(F.broadcast(known), "cluster").crossJoin(F.broadcast(total))
    per = per.select("cluster", held(F.col("own")).alias("cluster_inertia"), held(F.col("total")).alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(per), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster_vectors(stage(integer_vectors(read(spark, sf_dir, "embeddings")), "vectors")))


def _assignment(name: str, centroids: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT vec_id, rid, v, cluster, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place FROM (
      SELECT k.vec_id, k.rid, k.v, c.cluster,
        CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT) AS distance
      FROM kept k CROSS JOIN {centroids} c)) WHERE place = 1)"""


def _centroids(name: str, members: str, before: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b.cluster, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
      FROM {members} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid,
    list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) * {SCALE}, -{LIMIT}), {LIMIT})) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INT) AS cluster, v FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CLUSTERS})),
{_assignment("a0", "c0")},
{_centroids("c1", "a0", "c0")},
{_assignment("a1", "c1")},
{_centroids("c2", "a1", "c1")},
{_assignment("a2", "c2")},
{_centroids("c3", "a2", "c2")},
{_assignment("a3", "c3")}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
