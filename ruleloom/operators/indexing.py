"""Consecutive numbers over a total order, and ranges of equal depth, without a window over a whole table or group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.staging import stage


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in the given order.

    The rows are range-sorted and staged with (partition, row in partition); the partition offsets are running
    sums over one row per partition, joined back by broadcast.
    """
    marked = stage(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_mark", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, row + F.col("_offset"))
        .drop("_mark", "_part", "_offset")
    )


def group_index(df: DataFrame, group: Sequence[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 in the given order, however large a group is.

    The rows are numbered over (group, order) together; the first number of its group is taken off each. One row per group
    is broadcast, so there must be few groups, such as bags, folds or levels. Groups are never null.
    """
    numbered = global_index(df, [*[F.asc(g) for g in group], *order], name)
    if not group:
        return numbered
    firsts = numbered.groupBy(*group).agg(F.min(name).alias("_first"))
    return numbered.join(F.broadcast(firsts), [*group]).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def depth_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number ranges of the given order that hold about equally many rows, by Spark's range sampling; staged, so that they stay."""
    return stage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges")
