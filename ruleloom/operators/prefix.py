"""The prefix tree as a table: one row per (bag, prefix, label) with its count.

The parent of a node is its prefix without the last element; trees merge by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent_of(prefix: Column) -> Column:
    return F.slice(prefix, F.lit(1), F.greatest(F.size(prefix) - 1, F.lit(0)))


def prefix_nodes(baskets: DataFrame, path: str = "ranks") -> DataFrame:
    """Nodes of the tree holding the weighted paths `(bag_id, path, label, n)`."""
    depths = F.sequence(F.lit(1), F.size(path))
    prefixes = F.transform(depths, lambda k: F.slice(F.col(path), F.lit(1), k))
    return (
        baskets.where(F.size(path) > 0)
        .select("bag_id", "label", "n", F.explode(prefixes).alias("prefix"))
        .groupBy("bag_id", "prefix", "label")
        .agg(F.sum("n").alias("n"))
    )


def merge_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).groupBy("bag_id", "prefix", "label").agg(F.sum("n").alias("n"))


def stored_paths(nodes: DataFrame) -> DataFrame:
    """The weighted paths a tree was built from: a node's count less what goes on to its children.

    Each node adds its count to itself and takes it from its parent, so one aggregation does it, without a join.
    """
    own = nodes.select("bag_id", "prefix", "label", "n")
    passed_on = nodes.where(F.size("prefix") > 1).select(
        "bag_id", parent_of(F.col("prefix")).alias("prefix"), "label", (-F.col("n")).alias("n")
    )
    return (
        own.unionByName(passed_on)
        .groupBy("bag_id", "prefix", "label")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
        .withColumnRenamed("prefix", "ranks")
    )


def conditional_base(baskets: DataFrame, suffix: Column, path: str = "ranks") -> DataFrame:
    """Paths leading to the item `suffix`, with the counts of the records that reach it."""
    reach = F.slice(F.col(path), F.lit(1), F.array_position(F.col(path), suffix).cast("int") - 1)
    return (
        baskets.where(F.array_contains(F.col(path), suffix))
        .withColumn(path, reach)
        .groupBy("bag_id", path, "label")
        .agg(F.sum("n").alias("n"))
    )


def header_summary(baskets: DataFrame, path: str = "ranks") -> DataFrame:
    """Per-item class totals of a tree."""
    return (
        baskets.select("bag_id", "label", "n", F.explode(path).alias("item"))
        .groupBy("bag_id", "item", "label")
        .agg(F.sum("n").alias("n"))
    )
