"""Exact top-k inner-product search by MaxScore over shards of integer vectors.

A term is a component; its postings are the candidates' values. The contribution of a term to a query is shifted by
its least value in the shard, so that contributions start at zero and each term has an upper bound.

1. Candidates and queries fall into hashed blocks of bounded size; every (query block, candidate block) pair is one
   group of two bounded tables. This is the stated query set against all rows, in blocks: each candidate is sent once
   per query block.
2. In a group, terms are ordered by bound. The largest bounds are traversed first; a handful of good candidates is
   scored fully and gives the first threshold. Terms whose bounds together cannot reach it are non-essential: they
   are not traversed but probed, for candidates whose partial score plus remaining bounds still competes.
3. Every group returns at most k rows per query; Spark keeps the k best per task before merging the shards.

Scores are exact integers (sums beyond 2**53 are computed in Python integers and clamped to a long).

Defined results: vectors that are null or hold a null or non-finite component take no part, neither do rows without
an id; vectors of unequal length are padded with zeros; repeated rows of equal id and vector count once; rows of one
id with different vectors are candidates and queries of their own, never for each other; ties go to the smaller id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage

K = 5
SCALE = 256
EVERY = 50
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
# Terms traversed before the first threshold, and candidates scored for it.
HEAD, SEEDS = 8, 64
EXACT = 2**53

FOUND = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: valid vectors as whole numbers, distinct."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def whole(x: Column) -> Column:
    """Floor as a double, for any finite value: doubles beyond 2**53 are whole, others round and step down."""
    near = F.rint(x)
    return near - F.when(near > x, 1.0).otherwise(0.0)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of list column as a matrix, padded with zeros."""
    lists = column.combine_chunks()
    values, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Shard:
    """Candidates of one block with their postings by term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], vectors[order]
        self.postings = np.ascontiguousarray(self.rows.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), without ``query_id``."""
        others = np.ones(len(self.ids), bool)
        others[np.searchsorted(self.ids, query_id, "left") : np.searchsorted(self.ids, query_id, "right")] = False
        at = np.flatnonzero(others)
        if np.abs(query) @ np.maximum(np.abs(self.low), np.abs(self.high)) >= EXACT:
            scores = np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.rows[at]], object)
            return self._best(at, scores, k)
        low, high = query * self.low, query * self.high
        least, bound = np.minimum(low, high), np.abs(high - low)
        terms = np.argsort(-bound, kind="stable")
        terms = terms[bound[terms] > 0]
        rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0.0]))
        # The part of every score that is left when all contributions are shifted to start at zero.
        base = float(least.sum())
        partial = np.zeros(len(self.ids))
        for term in terms[:HEAD]:
            partial += query[term] * self.postings[term] - least[term]
        threshold = -math.inf
        if len(at) > k:
            seeds = at[np.argpartition(-partial[at], min(SEEDS, len(at)) - 1)[:SEEDS]]
            exact = self.rows[seeds] @ query
            threshold = float(np.partition(exact, len(exact) - k)[len(exact) - k])
        # Essential: all but the tail of terms whose bounds together stay below the threshold.
        essential = max(int(np.count_nonzero(base + rest[:-1] >= threshold)), min(HEAD, len(terms)))
        for term in terms[HEAD:essential]:
            partial += query[term] * self.postings[term] - least[term]
        at = at[base + partial[at] + rest[essential] >= threshold]
        sums = partial[at]
        for i in range(essential, len(terms)):
            sums += query[terms[i]] * self.postings[terms[i]][at] - least[terms[i]]
            competes = base + sums + rest[i + 1] >= threshold
            if not competes.all():
                at, sums = at[competes], sums[competes]
        return self._best(at, np.rint(base + sums).astype("int64"), k)

    def _best(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Candidates are in id order, so a stable sort gives ties to the smaller id."""
        order = np.argsort(-scores, kind="stable")[:k]
        return [(int(self.ids[at[i]]), max(min(int(scores[i]), 2**63 - 1), -(2**63))) for i in order]


def block_of(size: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", "v"), F.lit(size)).cast("int")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides have ``vec_id`` and whole-number vectors ``v``."""
    n_c = max(1, math.ceil(candidates.count() / candidate_block))
    n_q = max(1, math.ceil(queries.count() / query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", F.xxhash64("v").alias("key"), "v", block_of(n_q).alias("q"), every(n_c).alias("c"))
    right = candidates.select("vec_id", "v", block_of(n_c).alias("c"), every(n_q).alias("q"))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if asked.num_rows and held.num_rows:
            width = max(max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for t in (asked, held)), 1)
            shard = Shard(held.column("vec_id").to_numpy(), matrix(held.column("v"), int(width)))
            for query_id, key, query in zip(asked.column("vec_id").to_pylist(), asked.column("key").to_pylist(), matrix(asked.column("v"), int(width))):
                rows += [(query_id, key, vec_id, score) for vec_id, score in shard.top(query_id, query, k)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(integer_vectors(read(spark, sf_dir, "embeddings")).dropDuplicates(), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
