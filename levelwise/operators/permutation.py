"""Another random order in every epoch, without sorting all rows again.

Rows get their position once: the rank of (md5 of seed and id, id), taken within buckets of the hash and offset by the
counts of the buckets before it, so no range partitioning and no single task is needed, and partitioning has no
influence. An epoch's order is then a keyed permutation of 0 .. n-1, computed inside each row: alternately the blocks
of about sqrt(n) positions are turned by an amount that depends on the block, and all positions are multiplied by a
number without a common factor with n. Every step is a bijection of 0 .. n-1, so the whole is one.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelwise.operators.split import SEED, order_hash

# Rows that are ranked together, on average 1/16 of this at least.
BUCKET_ROWS = 1_000_000
STEPS = 4
# Primes of the turning amount, which stays below 2**32.
P, Q = 65521, 65519


def hash_positions(df: DataFrame, id_col: str = "id", seed: int = SEED) -> tuple[DataFrame, int]:
    """``df`` with ``position``, and the number of rows. Ids are unique.

    The table of bucket offsets has at most one row per 62,500 rows; it is broadcast.
    """
    n = df.count()
    digits = max(0, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    key = order_hash(id_col, seed)
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = df.select(F.substring(key, 1, digits).alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_bucket", before.alias("_before")))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col)) - 1
    placed = keyed.withColumn("_rank", rank).join(offsets, "_bucket")
    return placed.withColumn("position", F.col("_before") + F.col("_rank")).drop("_key", "_bucket", "_rank", "_before"), n


def epoch_steps(n: int, epoch: int, seed: int = SEED) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Block length, and (turn, turn, factor, shift) of every step."""
    chance = random.Random(f"{seed}-{epoch}")
    steps = []
    for _ in range(STEPS):
        top = max(2, min(n, 2**62 // max(n, 1)))
        factor = chance.randrange(1, top)
        while math.gcd(factor, n) != 1:
            factor = chance.randrange(1, top)
        steps.append((chance.randrange(P), chance.randrange(Q), factor, chance.randrange(max(n, 1))))
    return max(1, math.isqrt(n)), steps


def with_place(df: DataFrame, n: int, epoch: int, position: str = "position", place: str = "place", seed: int = SEED) -> DataFrame:
    """Add where the row at ``position`` stands in the order of ``epoch``: a bijection of 0 .. n-1, for n below 2**40.

    Each step is a projection of its own, so that no step's arithmetic is written out again in the next.
    """
    if n >= 2**40:
        raise ValueError("positions beyond 2**40 would overflow")
    df = df.withColumn(place, F.col(position).cast("long"))
    if n < 2:
        return df
    block, steps = epoch_steps(n, epoch, seed)
    for a, b, factor, shift in steps:
        # Every block of positions is rotated in itself; the last one may be shorter.
        df = df.withColumn("_within", F.col(place) % block)
        df = df.withColumn("_low", F.col(place) - F.col("_within"))
        df = df.withColumn("_number", (F.col("_low") / block).cast("long"))  # exact: both are whole and below 2**53
        size = F.least(F.lit(block).cast("long"), F.lit(n).cast("long") - F.col("_low"))
        amount = ((F.col("_number") + a) % P) * ((F.col("_number") + b) % Q)
        df = df.withColumn(place, F.col("_low") + (F.col("_within") + amount) % size)
        df = df.withColumn(place, (F.col(place) * factor + shift) % n)
    return df.drop("_within", "_low", "_number")


def shuffled_parts(positioned: DataFrame, n: int, epoch: int, part_rows: int, seed: int = SEED) -> DataFrame:
    """Rows of an epoch with ``place`` and ``part``; each part of ``part_rows`` rows lies in one task, in its order.

    One hash exchange by part; no sampling and no range partitioning.
    """
    placed = with_place(positioned, n, epoch, seed=seed)
    parted = placed.withColumn("part", ((F.col("place") - F.col("place") % part_rows) / part_rows).cast("long"))
    return parted.repartition(max(1, math.ceil(n / part_rows)), "part").sortWithinPartitions("place")
