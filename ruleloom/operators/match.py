"""Which rules apply to which records: set containment as an equi-join.

Each rule is filed under one item of its antecedent, the one least used by strong rules. A record can only match the
rules filed under its own items; the rest of the antecedent is then checked on the joined row. The check is a
chain of plain array lookups, so that it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.staging import stage_observed

# A rule table up to this many antecedent items is broadcast. A larger one is joined by shuffle, its anchors salted.
BROADCAST_ITEMS = 1_000_000
SALTS = 16


def contains_all(items: Column, wanted: Column, longest: int) -> Column:
    """wanted is a subset of items; `longest` bounds the size of wanted."""
    held = F.lit(True)
    for i in range(longest):
        held = held & ((F.size(wanted) <= i) | F.array_contains(items, F.get(wanted, F.lit(i))))
    return held


@dataclass(frozen=True)
class RuleIndex:
    """Rules filed by anchor item. `longest` is the largest number of further antecedent items."""

    table: DataFrame
    longest: int
    items: int
    broadcast_items: int = BROADCAST_ITEMS

    @property
    def small(self) -> bool:
        return self.items <= self.broadcast_items


def index_rules(
    rules: DataFrame, keys: Sequence[str], keep: Sequence[str], broadcast_items: int = BROADCAST_ITEMS
) -> RuleIndex:
    """File each rule, identified by `keys`, under one antecedent item; `keep` columns travel along.

    `rules` is read twice and should be a staged table.
    """
    columns = [*keys, "antecedent", "support", *keep]
    uses = rules.select(*columns, F.explode("antecedent").alias("item"))
    heat = uses.groupBy("item").agg(F.sum("support").alias("heat"))
    table, seen = stage_observed(
        uses.join(heat, "item")
        .groupBy(*columns)
        .agg(F.min_by("item", F.struct(F.round("heat", 9), F.col("item"))).alias("anchor"))
        .withColumn("others", F.array_remove("antecedent", F.col("anchor")))
        .drop("antecedent"),
        "rule-index",
        longest=F.max(F.size("others")),
        items=F.sum(F.size("others") + 1),
    )
    return RuleIndex(table, seen["longest"] or 0, seen["items"] or 0, broadcast_items)


def match(
    tx: DataFrame, index: RuleIndex, on: Sequence[str] = (), how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Pairs of records and applying rules, `on` further equal columns. Drops `items`.

    how="left" also gives each record at least one row without a rule, so that grouping by record loses none.
    """
    rows = tx.select("*", F.explode_outer("items").alias("anchor"))
    rules, keys = index.table, [*on, "anchor"]
    if index.small:
        rules = F.broadcast(rules)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*tx.columns), F.lit(salts)).cast("int"))
        rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    left, right = rows.alias("l"), rules.alias("r")
    equal = F.lit(True)
    for key in keys:
        equal = equal & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    condition = equal & contains_all(F.col("l.items"), F.col("r.others"), index.longest)
    kept = [F.col(f"l.{c}") for c in tx.columns if c != "items"]
    added = [F.col(f"r.{c}") for c in index.table.columns if c not in (*keys, "others", *tx.columns)]
    return left.join(right, condition, how).select(*kept, *added)
