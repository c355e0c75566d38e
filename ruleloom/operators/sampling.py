"""Bags, strata, folds and splits, all drawn by hashing the record id."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.hashing import hash32, poisson_copies, uniform
from ruleloom.operators.indexing import global_index

STRATEGIES = ("support", "gain")


def check_bagging(
    strategy: str, num_models: int, with_shuffling: bool, with_replacement: bool, partitions: int | None = None
) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be gain or support, got {strategy!r}")
    if not with_shuffling and with_replacement:
        raise ValueError("sampling with replacement needs shuffling")
    if not with_shuffling and partitions is not None and partitions < num_models:
        raise ValueError(f"cannot make {num_models} bags from {partitions} partitions without shuffling")


def expand_copies(df: DataFrame, draw: Column, copies: Callable[[Column], Column]) -> DataFrame:
    """Repeat each row `copies(draw)` times; adds `copy` = 1, 2, ... The draw is computed once per row."""
    drawn = df.withColumn("_draw", draw).withColumn("_copies", copies(F.col("_draw")))
    numbered = F.posexplode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("copy", "_zero")
    return drawn.select(*df.columns, numbered).drop("_zero").withColumn("copy", F.col("copy") + 1)


def bag_sample(
    tx: DataFrame,
    num_models: int,
    sample_size: float,
    with_replacement: bool = True,
    seed: int = 0,
    id_col: str = "rec_id",
    even: bool = False,
) -> DataFrame:
    """Sample the fraction num_models * sample_size once and deal it over the bags: adds `copy`, `bag_id`.

    Each copy goes to the bag that its hash says, without a shuffle; or, with `even`, the copies are numbered in the order of
    their hashes and dealt in turn, so that the sizes of two bags differ by one at most.
    """
    fraction = num_models * sample_size
    draw = uniform(F.col(id_col), f"bag{seed}")
    if with_replacement:
        sampled = expand_copies(tx, draw, lambda u: poisson_copies(u, fraction))
    else:
        if fraction > 1.0:
            raise ValueError(f"cannot sample the fraction {fraction} without replacement")
        sampled = tx.where(draw < fraction).withColumn("copy", F.lit(1))
    card = F.concat_ws("/", F.col(id_col).cast("string"), F.col("copy").cast("string"))
    deal = hash32(card, f"deal{seed}")
    if even:
        numbered = global_index(sampled.withColumn("_deal", deal), [F.asc("_deal"), F.asc(id_col), F.asc("copy")], "_place")
        return numbered.withColumn("bag_id", (F.col("_place") % num_models).cast("int")).drop("_deal", "_place")
    return sampled.withColumn("bag_id", (deal % num_models).cast("int"))


def bag_contiguous(
    tx: DataFrame, num_models: int, sample_size: float, seed: int = 0, id_col: str = "rec_id"
) -> DataFrame:
    """Bernoulli sample cut into bags of neighbouring ids, sizes equal up to one record."""
    fraction = num_models * sample_size
    sampled = tx.where(uniform(F.col(id_col), f"bag{seed}") < fraction).withColumn("copy", F.lit(1))
    indexed = global_index(sampled, [F.asc(id_col)], "_index")
    total = indexed.agg(F.count("*").alias("n")).first()["n"]
    return indexed.withColumn("bag_id", F.floor(F.col("_index") * num_models / F.lit(max(total, 1))).cast("int")).drop(
        "_index"
    )


def bag_by_partition(
    tx: DataFrame, num_models: int, sample_size: float, seed: int = 0, id_col: str = "rec_id"
) -> DataFrame:
    """Bernoulli sample whose bags are groups of neighbouring input partitions: no shuffle at all."""
    partitions = tx.rdd.getNumPartitions()
    check_bagging("support", num_models, False, False, partitions)
    fraction = num_models * sample_size
    return (
        tx.withColumn("bag_id", F.floor(F.spark_partition_id() * num_models / F.lit(partitions)).cast("int"))
        .where(uniform(F.col(id_col), f"bag{seed}") < fraction)
        .withColumn("copy", F.lit(1))
    )


def one_bag(tx: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """All records in bag 0. The id is computed, not constant, so joins on it stay equi-joins."""
    return tx.withColumn("bag_id", F.pmod(F.hash(id_col), F.lit(1)))


def stratified_resample(
    tx: DataFrame, fractions: Mapping[object, float], seed: int = 0, id_col: str = "rec_id"
) -> DataFrame:
    """Poisson resampling with replacement, one rate per class; classes without a rate are dropped."""
    draw = uniform(F.col(id_col), f"strata{seed}")

    def copies(u: Column) -> Column:
        number = F.lit(0)
        for label, rate in fractions.items():
            number = F.when(F.col("label") == F.lit(label), poisson_copies(u, rate)).otherwise(number)
        return number

    return expand_copies(tx, draw, copies)


def balancing_fractions(class_counts: Mapping[object, int], mode: str) -> dict[object, float]:
    """Rates that bring every class to the size of the largest (over) or the smallest (under) one."""
    if mode not in ("over", "under"):
        raise ValueError(f"mode must be over or under, got {mode!r}")
    goal = max(class_counts.values()) if mode == "over" else min(class_counts.values())
    return {label: goal / n for label, n in class_counts.items()}


def fold_of(id_col: Column, k: int, seed: int = 12345) -> Column:
    return (hash32(id_col, f"fold{seed}") % k).cast("int")


def kfold(tx: DataFrame, k: int = 10, seed: int = 12345, id_col: str = "rec_id") -> DataFrame:
    """Adds `fold`: the record is tested in that fold and trained on in all others."""
    return tx.withColumn("fold", fold_of(F.col(id_col), k, seed))


def training_folds(tx: DataFrame, k: int) -> DataFrame:
    """One row per fold the record is trained in: `fold` becomes each fold but its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return tx.withColumn("fold", F.explode(others))


def train_test_split(
    tx: DataFrame, train: float = 0.7, seed: int = 0, id_col: str = "rec_id"
) -> tuple[DataFrame, DataFrame]:
    draw = uniform(F.col(id_col), f"split{seed}")
    return tx.where(draw < train), tx.where(draw >= train)
