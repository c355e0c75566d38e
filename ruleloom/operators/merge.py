"""Merge rules of several bags into one model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.rules import order_rules

METHODS = ("max", "min", "product")


def combined(value: str, method: str) -> Column:
    """max, min, or product = 1 - (1-v1)(1-v2)... of a measure over equal rules."""
    if method == "product":
        return F.lit(1.0) - F.product(1.0 - F.col(value))
    return {"max": F.max, "min": F.min}[method](value)


def merge_rules(rules: DataFrame, method: str = "max", within: tuple[str, ...] = ()) -> DataFrame:
    """One rule per (set of antecedent items, consequent, level) over all bags; the result is bag 0, ranked anew.

    All three methods are associative, so one aggregation replaces pairwise merging. The antecedent is listed as in
    the first bag that has the rule. chi2 is always the largest. Counts do not add up over overlapping bags and are
    dropped. `within` keeps models apart, e.g. by fold.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    merged = (
        rules.withColumn("_set", F.array_sort("antecedent"))
        .groupBy(*within, "level", "_set", "consequent")
        .agg(
            F.min_by("antecedent", F.struct("bag_id", "rank")).alias("antecedent"),
            combined("support", method).alias("support"),
            combined("confidence", method).alias("confidence"),
            F.max("chi2").alias("chi2"),
        )
    )
    ranked = order_rules(merged.withColumn("bag_id", F.lit(0)), [*within, "level"])
    return ranked.select(
        *within, "bag_id", "level", "rank", "antecedent", "consequent", "support", "confidence", "chi2"
    )
