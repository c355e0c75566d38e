"""Rule tables: filtering, order, rendering.

A rule table has bag_id, level (1 used, 2 spare), rank, antecedent, consequent, the counts n_ant, n_hit, n_class,
n_total, and support, confidence, chi2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.functions.metrics import passes, rule_text, with_metrics
from ruleloom.operators.indexing import group_index
from ruleloom.operators.items import class_counts

MEASURES = ("antecedent", "consequent", "n_ant", "n_hit", "n_class", "n_total", "support", "confidence", "chi2")


def text_of() -> Column:
    return rule_text(*(F.col(c) for c in ("antecedent", "consequent", "support", "confidence", "chi2")))


def rule_order() -> list[Column]:
    """Better rules first: confidence, support, longer antecedent, rendered text, all falling."""
    return [F.desc("confidence"), F.desc("support"), F.desc(F.size("antecedent")), F.desc(text_of())]


def order_rules(rules: DataFrame, within: Sequence[str] = ("bag_id",)) -> DataFrame:
    """`rank` 1, 2, ... in rule order within the columns `within`. No task sorts a whole bag."""
    ranked = group_index(rules, within, rule_order(), "rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))


def measure(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Add class and bag counts and the three measures to rows with consequent, n_ant and n_hit."""
    bag = W.partitionBy("bag_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    classes = class_counts(counts).select(
        "bag_id", F.col("label").alias("consequent"), "n_class", F.sum("n_class").over(bag).alias("n_total")
    )
    return with_metrics(found.join(classes, ["bag_id", "consequent"]))


def keep_rules(
    measured: DataFrame, min_confidence: float, min_chi2: float, exempt: Column | None = None
) -> DataFrame:
    """Apply the confidence and chi-square bounds to all rules but the exempt ones."""
    good = passes(min_confidence, min_chi2)
    return measured.where(good if exempt is None else good | exempt)


def finish(rules: DataFrame) -> DataFrame:
    return order_rules(rules).select("bag_id", F.lit(1).alias("level"), "rank", *MEASURES)


def rules_text(rules: DataFrame) -> DataFrame:
    """One line per rule; print a model by ordering the lines by bag_id, level, rank."""
    return rules.select("bag_id", "level", "rank", text_of().alias("line"))


def write_text(rules: DataFrame, path: str) -> None:
    """Write the model as text, sorted, under a heading per bag."""
    lines = rules_text(rules)
    headings = lines.groupBy("bag_id").agg(F.lit(0).alias("level"), F.lit(0).alias("rank")).withColumn(
        "line", F.concat(F.lit("Model "), F.col("bag_id").cast("string"), F.lit(":"))
    )
    lines.unionByName(headings).orderBy("bag_id", "level", "rank").select("line").write.text(path)


def model_stats(rules: DataFrame, bags: DataFrame) -> DataFrame:
    """Rules, antecedent items and mean antecedent length per level over all bags of `bags`.

    The mean length is the mean of the bags' means; a bag without rules counts as 0.
    """
    size = F.size("antecedent")
    per_bag = bags.select("bag_id").join(
        rules.groupBy("bag_id").agg(
            *[F.count(F.when(F.col("level") == v, 1)).alias(f"rules_{v}") for v in (1, 2)],
            *[F.sum(F.when(F.col("level") == v, size)).alias(f"items_{v}") for v in (1, 2)],
            *[F.avg(F.when(F.col("level") == v, size)).alias(f"length_{v}") for v in (1, 2)],
        ),
        "bag_id",
        "left",
    )
    return per_bag.agg(
        *[F.coalesce(F.sum(f"rules_{v}"), F.lit(0)).alias(f"rules_{v}") for v in (1, 2)],
        *[F.coalesce(F.sum(f"items_{v}"), F.lit(0)).alias(f"items_{v}") for v in (1, 2)],
        *[F.coalesce(F.avg(F.coalesce(f"length_{v}", F.lit(0.0))), F.lit(0.0)).alias(f"length_{v}") for v in (1, 2)],
    )
