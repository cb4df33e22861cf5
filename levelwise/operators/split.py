"""Exact stratified split without moving the rows.

Every row has a position in its label: its rank by (md5 of seed and id, id).
The first ``train`` rows of a label are training rows, the next ``val`` rows
validation, the rest test. Ranking a whole label would push it through one
task, so only two *cut points* per label are located:

1. count rows per (label, first two hash digits): a map-side-combined
   aggregation of at most 256 rows per label and task;
2. running totals over that small table tell which cell holds each cut;
3. only rows of those cells, about 1/256 of a label, are counted again by their
   first five digits, which narrows each cut to a millionth of its label;
4. only the rows of those last cells are ranked to find the row at the cut.

Every shuffle is tiny, each pass reads the id and label columns alone, and
assigning the rows is a comparison with the broadcast cut points, one row per
label: the text is read once and never shuffled, whatever the label skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from levelwise.functions.labels import LEVELS

# Leading hash digits of the coarse and the fine cells.
COARSE, FINE = 2, 5

# Hold-out share in per cent, the test share of the hold-out in
# per cent, and the split names.
HOLDOUT_PCT = 30
TEST_PCT_OF_HOLDOUT = 50
SPLITS = ("train", "val", "test")
SEED = 42

# Exact up to 10^18 rows: counts are multiplied before they are divided.
WIDE = "decimal(38,0)"


def order_hash(id_col: str, seed: int = SEED) -> Column:
    """Seeded, partition-independent sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def shuffle_rows(df: DataFrame, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Rows in a reproducible random order (range-partitioned global sort)."""
    key = order_hash(id_col, seed)
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key", id_col)


def stratified_quotas(
    counts: DataFrame,
    label_id: str = "label_id",
    n: str = "n",
    holdout_pct: int = HOLDOUT_PCT,
    test_pct: int = TEST_PCT_OF_HOLDOUT,
    levels: Sequence[str] = LEVELS,
    allow_rare: bool = False,
) -> DataFrame:
    """Rows of each label per split, by largest remainder in integer arithmetic.

    ``counts`` has one row per label. The hold-out takes ``ceil`` of its share
    and so does the test part of the hold-out; equal remainders go to the
    lower label. A label with one row, or a split smaller than the number of
    labels, is refused unless ``allow_rare``, which trains on such labels.
    """
    rare = F.col(n) < 2
    base = counts.select(
        F.col(label_id).alias("label_id"),
        F.col(n).alias("n"),
        F.when(F.lit(allow_rare) & rare, F.lit(0)).otherwise(F.col(n)).cast(WIDE).alias("pool"),
    )
    everything = Window.partitionBy()
    base = base.withColumns({
        "total": F.sum("pool").over(everything).cast(WIDE), "classes": F.count(F.lit(1)).over(everything)
    })
    base = base.withColumn("n_hold", _ceil_pct(F.col("total"), holdout_pct))
    base = base.withColumn("n_test", _ceil_pct(F.col("n_hold"), test_pct))
    base = base.withColumns({
        "n_train": (F.col("total") - F.col("n_hold")).cast(WIDE),
        "n_val": (F.col("n_hold") - F.col("n_test")).cast(WIDE),
    })
    if not allow_rare:
        code = F.get(F.array(*[F.lit(level) for level in levels]), F.col("label_id"))
        too_few = F.concat(F.lit("stratified split needs at least 2 rows of every label; too few of "), code)
        too_small = F.lit("stratified split: a split would be smaller than the number of labels")
        smallest = F.least("n_train", "n_val", "n_test")
        base = base.withColumn(
            "n",
            F.when(rare, F.raise_error(too_few).cast("long"))
            .when(smallest < F.col("classes"), F.raise_error(too_small).cast("long"))
            .otherwise(F.col("n")),
        )
    base = _largest_remainder(base, "pool", "n_train", "total", "train")
    base = base.withColumn("held", (F.col("pool") - F.col("train")).cast(WIDE))
    base = _largest_remainder(base, "held", "n_val", "n_hold", "val")
    return base.select(
        "label_id",
        "n",
        (F.col("n") - F.col("held").cast("long")).alias("train"),
        F.col("val").cast("long").alias("val"),
        (F.col("held") - F.col("val")).cast("long").alias("test"),
    )


def stratified_split(
    df: DataFrame, id_col: str = "id", label_id: str = "label_id", seed: int = SEED, **options
) -> DataFrame:
    """Add a ``split`` column: train, val or test. ``id_col`` must be unique.

    ``options`` are those of :func:`split_cuts`.
    """
    return assign_split(df, split_cuts(df, id_col, label_id, seed, **options), id_col, label_id, seed)


def split_cuts(
    df: DataFrame,
    id_col: str = "id",
    label_id: str = "label_id",
    seed: int = SEED,
    holdout_pct: int = HOLDOUT_PCT,
    test_pct: int = TEST_PCT_OF_HOLDOUT,
    levels: Sequence[str] = LEVELS,
    allow_rare: bool = False,
) -> DataFrame:
    """Last training and last validation row of each label: one row per label."""
    keys = df.where(F.col(label_id).isNotNull()).select(
        F.col(label_id).alias("label_id"), F.col(id_col).alias("row_id"), order_hash(id_col, seed).alias("h")
    )
    cells = keys.groupBy("label_id", F.substring("h", 1, COARSE).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    quotas = stratified_quotas(
        cells.groupBy("label_id").agg(F.sum("n").alias("n")),
        holdout_pct=holdout_pct, test_pct=test_pct, levels=levels, allow_rare=allow_rare,
    )
    ranks = quotas.select(
        "label_id",
        F.explode(F.array(
            F.struct(F.lit("train").alias("cut"), F.col("train").alias("rank")),
            F.struct(F.lit("val").alias("cut"), (F.col("train") + F.col("val")).alias("rank")),
        )).alias("c"),
    ).select("label_id", "c.cut", "c.rank")

    coarse = _cells_at_rank(cells.join(F.broadcast(ranks), "label_id"))
    finer = _rows_in(keys, coarse, COARSE).groupBy(
        "label_id", "cut", "rank", F.substring("h", 1, FINE).alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    fine = _cells_at_rank(finer)

    in_cell = Window.partitionBy("label_id", "cut").orderBy("h", "row_id")
    return (
        _rows_in(keys, fine, FINE)
        .withColumn("rn", F.row_number().over(in_cell))
        .where(F.col("rn") == F.col("rank"))
        .groupBy("label_id")
        .agg(*[
            F.max(F.when(F.col("cut") == cut, F.struct("h", "row_id"))).alias(f"_{cut}_end") for cut in ("train", "val")
        ])
        .withColumnRenamed("label_id", label_id)
    )


def assign_split(
    df: DataFrame, cuts: DataFrame, id_col: str = "id", label_id: str = "label_id", seed: int = SEED
) -> DataFrame:
    """Compare every row with the cut points of its label; no row moves."""
    here = F.struct(order_hash(id_col, seed).alias("h"), F.col(id_col).alias("row_id"))
    no_label = F.raise_error(F.lit("stratified split: a row has no label")).cast("string")
    split = (
        F.when(F.col(label_id).isNull(), no_label)
        .when(here <= F.col("_train_end"), F.lit("train"))
        .when(here <= F.col("_val_end"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return (
        df.join(F.broadcast(cuts), label_id, "left")
        .withColumn("split", split)
        .drop("_train_end", "_val_end")
        .select(*df.columns, "split")
    )


def _cells_at_rank(counts: DataFrame) -> DataFrame:
    """The cell of each (label, cut) that holds the wanted rank, and the rank inside it."""
    in_order = Window.partitionBy("label_id", "cut").orderBy("cell")
    reached = F.sum("n").over(in_order)
    running = counts.withColumn("reached", reached).withColumn("before", F.col("reached") - F.col("n"))
    held = running.where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("reached")))
    return held.select("label_id", "cut", "cell", (F.col("rank") - F.col("before")).alias("rank"))


def _rows_in(keys: DataFrame, cells: DataFrame, digits: int) -> DataFrame:
    """Rows of the given cells; ``cells`` has two rows per label at most."""
    return keys.withColumn("cell", F.substring("h", 1, digits)).join(F.broadcast(cells), ["label_id", "cell"])


def _ceil_pct(total: Column, pct: int) -> Column:
    return F.ceil(total * F.lit(pct) / F.lit(100)).cast(WIDE)


def _largest_remainder(df: DataFrame, size: str, draws: str, total: str, out: str) -> DataFrame:
    """``size * draws / total`` rounded down, plus one for the largest remainders."""
    scaled = (F.col(size) * F.col(draws)).cast(WIDE)
    some = F.col(total) > 0
    shares = df.withColumns({
        "whole": F.when(some, F.call_function("div", scaled, F.col(total))).otherwise(F.lit(0)).cast(WIDE),
        "rest": F.when(some, scaled % F.col(total)).otherwise(F.lit(0)).cast(WIDE),
    })
    missing = F.col(draws) - F.sum("whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "label_id"))
    extra = F.when(place <= missing, F.lit(1)).otherwise(F.lit(0))
    return shares.withColumn(out, (F.col("whole") + extra).cast(WIDE)).drop("whole", "rest")
