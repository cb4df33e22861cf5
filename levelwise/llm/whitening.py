"""Whitening of embedding vectors by the leading components, found by contour integration (FEAST).

1. Vectors become whole numbers; the fit list holds each distinct vector once (an aggregate that combines before the
   shuffle, so a hot copy is one row per task) and is written to the shared folder.
2. Two passes over the fit list gather its exact sums and the matrix of centred products. Tasks send one row per
   cell of the triangle and Spark adds them up, so the driver receives ``width ** 2 / 2`` numbers at any size.
3. Inertia counts (signs of a symmetric factorisation of the shifted covariance) place disjoint intervals over the
   wanted eigenvalues, with edges clear of any eigenvalue, and say how many each holds. For each interval the
   quadrature of complex shifted solves on a circle projects a random block onto the interval's eigenspace, and
   Rayleigh-Ritz extracts the pairs. An interval is done when its pairs are as many as its count and their residuals
   are at rounding level; the count of the whole range is checked at the end.
4. A third pass measures the covariance of the whitened fit list; the last one projects every row.

The matrix work on the driver is bounded by the width of a vector, not by rows.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; a null id stays null;
repeated rows give repeated results and count once in the fit; shorter vectors (empty ones included) are padded with
zero entries; entries beyond 2**52 after scaling are held there; tied eigenvalues give any orthonormal basis of their
space, the same for all rows; components without variance (at most 1e-11 of the trace) are left out, so one distinct
vector gives no rows, and so does an empty table; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage
from levelwise.llm.maxscore import whole

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = float(2**52)
# Quadrature nodes on the half circle, most eigenvalues per interval, rounds of refinement, and accepted residual.
NODES, SLICE, ROUNDS, RESIDUAL = 12, 12, 12, 4e-14
NEGLIGIBLE = 1e-11
LONG = 2**63 - 1

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def shifted_vectors(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: valid vectors as longs, all of one length."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: whole(F.greatest(F.least(c.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT)))
    x = F.transform("embedding", lambda c: scaled(c).cast("long") + shift)
    valid = rows.filter(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    width = valid.agg(F.max(F.size("x"))).first()[0] or 0
    padding = F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x"))
    return valid.withColumn("x", F.concat("x", padding))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Centre:
    """Number and sums of the fit list; differences to the mean are taken in whole numbers."""

    n: int
    sums: tuple[int, ...]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: as longs where they fit, as Python integers elsewhere."""
        if not x.size:
            return x
        largest = max(int(x.max()), -int(x.min()), 1)
        if 2 * self.n * largest < 2**62 and max(map(abs, self.sums)) < 2**62:
            return x * np.int64(self.n) - np.array(self.sums, "int64")
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` to double precision."""
        return self.spread(x).astype("float64") / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of ``n * x - S`` per row; null beyond a long."""
        d = self.spread(x)
        if d.dtype != object and d.size and float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
            return (d * d).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v <= LONG else None for v in exact]


def fit_centre(fit: DataFrame) -> Centre:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            x = as_matrix(batch.column(0))
            n += len(x)
            # Halves of 32 bits add up without overflow.
            high = x >> 32
            total = total + high.sum(axis=0).astype(object) * 2**32 + (x - (high << 32)).sum(axis=0).astype(object)
        if n:
            at = pa.array(range(-1, len(total)), pa.int32())
            yield pa.record_batch([at, pa.array([str(n), *map(str, total)])], names=["at", "total"])

    parts = fit.mapInArrow(sums, "at int, total string")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    by = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(total).collect()}
    return Centre(by.pop(-1, 0), tuple(by[i] for i in sorted(by)))


def mean_products(fit: DataFrame, n: int, width: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of the outer products of ``values(x)``, a width-column matrix per batch."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                y = values(as_matrix(batch.column(0)))
                total += y.T @ y
                any_row = True
        if any_row:
            i, j = np.triu_indices(width)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for i, j, v in fit.mapInArrow(cells, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v / n
    return out


def positive_count(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues: inertia of a symmetric factorisation with complete pivoting."""
    a, positive = np.array(matrix, "float64"), 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        k = len(a)
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), k)
        if diagonal[r] == 0 and off[p, q] == 0:
            break
        pivot = [r] if diagonal[r] >= alpha * off[p, q] else [p, q]
        rest = [i for i in range(k) if i not in pivot]
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        # A two-by-two pivot of this rule has one eigenvalue of either sign.
        positive += 1 if len(pivot) == 2 else int(block[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


class Spectrum:
    """Leading eigenpairs of a symmetric matrix."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.width = matrix, len(matrix)
        radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
        self.scale = float(np.abs(matrix).sum(axis=1).max())
        margin = 1e-3 * self.scale
        self.low, self.high = float((np.diag(matrix) - radius).min()) - margin, float((np.diag(matrix) + radius).max()) + margin

    def above(self, value: float) -> int:
        return positive_count(self.matrix - value * np.eye(self.width))

    def clear(self, value: float) -> bool:
        """No eigenvalue lies so near that rounding could put it on either side."""
        near = 1e-9 * self.scale
        return self.above(value - near) == self.above(value + near)

    def intervals(self, wanted: int) -> list[tuple[float, float, int]]:
        """Disjoint intervals from the top that together hold at least ``wanted`` eigenvalues."""
        low, high, total = self.low, self.high, self.width
        left = self.low
        while high - left > 1e-8 * self.scale:
            middle = (left + high) / 2
            count = self.above(middle)
            if count < wanted:
                high = middle
                continue
            left = middle
            if self.clear(middle):
                low, total = middle, count
                if count <= wanted + wanted // 2:
                    break
        return self._split(low, self.high, total)

    def _split(self, low: float, high: float, count: int) -> list[tuple[float, float, int]]:
        if count == 0:
            return []
        top = self.above(high)
        if count > SLICE:
            left, right = low, high
            for _ in range(40):
                middle = (left + right) / 2
                upper = self.above(middle) - top
                if 0 < upper < count and self.clear(middle):
                    return self._split(middle, high, upper) + self._split(low, middle, count - upper)
                left, right = (middle, right) if upper > count // 2 else (left, middle)
        return [(low, high, count)]

    def project(self, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
        """Quadrature of the resolvent over the circle on ``low, high``; conjugate halves share their solves."""
        at, weights = np.polynomial.legendre.leggauss(nodes)
        centre, radius, out = (low + high) / 2, (high - low) / 2, np.zeros_like(block)
        for turn, weight in zip(np.exp(0.5j * np.pi * (at + 1)), weights):
            shifted = (centre + radius * turn) * np.eye(self.width) - self.matrix
            out += 0.5 * weight * (radius * turn * np.linalg.solve(shifted, block.astype(complex))).real
        return out

    def pairs(self, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` eigenpairs of an interval."""
        size, nodes, random = max(count + 4, 3 * count // 2), NODES, np.random.default_rng(11)
        for _ in range(4):
            size = min(self.width, size)
            block = random.standard_normal((self.width, size))
            for _ in range(ROUNDS):
                u, s, _ = np.linalg.svd(self.project(block, low, high, nodes), full_matrices=False)
                basis = u[:, s > 1e-13 * s[0]]
                values, rotation = np.linalg.eigh(basis.T @ self.matrix @ basis)
                block = basis @ rotation
                residual = np.linalg.norm(self.matrix @ block - block * values, axis=0)
                inside = (values > low) & (values < high) & (residual <= RESIDUAL * self.width**0.5 * self.scale)
                if inside.sum() == count:
                    return values[inside], block[:, inside]
            size, nodes = 2 * size, 2 * nodes
        raise RuntimeError(f"{count} eigenvalues lie between {low} and {high}, {int(inside.sum())} were found")

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest eigenvalues, falling, and their vectors as columns."""
        parts = self.intervals(min(wanted, self.width))
        found = [self.pairs(*part) for part in parts]
        # One more extraction over all intervals together makes their vectors orthogonal to rounding.
        basis = np.linalg.qr(np.concatenate([v for _, v in found], axis=1))[0]
        values, rotation = np.linalg.eigh(basis.T @ self.matrix @ basis)
        if len(values) != self.above(parts[-1][0]):
            raise RuntimeError("the intervals miss eigenvalues")
        order = np.argsort(-values, kind="stable")[:wanted]
        return values[order], (basis @ rotation)[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Projections of every row of ``vec_id, x`` on the leading components of the distinct vectors."""
    spark = vectors.sparkSession
    fit = stage(vectors.select("x").distinct(), "fit-list")
    centre = fit_centre(fit)
    width = len(centre.sums)
    covariance = mean_products(fit, centre.n, width, centre.centred) if width else np.zeros((0, 0))
    trace = float(np.trace(covariance))
    if not trace > 0:
        return spark.createDataFrame([], WHITENED)
    # Scaled to a trace of one, so that no size of entries matters to the solves.
    values, axes = Spectrum(covariance / trace).leading(components)
    kept = values > NEGLIGIBLE
    values, axes = values[kept], axes[:, kept]
    directions = axes / np.sqrt(values * trace)
    k = len(values)
    spread = mean_products(fit, centre.n, k, lambda x: centre.centred(x) @ directions)
    error = float(np.abs(spread - np.eye(k)).max())
    explained = values.tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("x"))
            if not len(x):
                continue
            ids = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                batch.column("vec_id").take(pa.array(ids)),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(ids), centre.n), pa.int64()),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(ids)),
                pa.array((centre.centred(x) @ directions).ravel()),
                pa.array(explained * len(x), pa.float64()),
                pa.array(np.full(len(ids), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(project, WHITENED)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(stage(shifted_vectors(read(spark, sf_dir, "embeddings")), "vectors"))
