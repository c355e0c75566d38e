"""Rules from the gain-ordered prefix tree.

Items are ranked by information gain and every record becomes the path of its ranked items. A node of the tree is
qualified if it and all its ancestors gain over their parents and reach the minimum class count, and no strict
ancestor is pure. A qualified node yields one rule: the majority class of the node, measured on all records that
contain the path's items. Among the rules passing the filter the deepest of each branch are kept.

The tree is never built: its nodes are an aggregation over path prefixes, taken a few depths at a time and only below
nodes that are still qualified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.metrics import gain, gain_exceeds
from ruleloom.operators.items import (
    RANK_MAP_LIMIT,
    bag_limits,
    bag_totals,
    class_list,
    class_sums,
    decode,
    distinct_items,
    item_counts,
    items_by_rank,
    label_counts,
    min_count,
    rank_items,
    ranked_baskets,
    stage_ranks,
    sums_largest,
    sums_majority,
    sums_squares,
    sums_total,
    weight,
)
from ruleloom.operators.match import RuleIndex, match
from ruleloom.operators.prefix import parent_of
from ruleloom.operators.rules import finish, keep_rules, measure
from ruleloom.staging import spread, stage, stage_observed

# Depths of the tree looked at per pass over the paths.
DEPTHS_PER_ROUND = 6


def node_table(
    paths: DataFrame, classes: list, first_depth: int = 0, last_depth: int | None = None
) -> DataFrame:
    """(bag_id, prefix, n, n_max, squares, label) of the nodes in a range of depths; label is the node's majority.

    Ties between classes go to the smallest label. Depth 0 is the root: it counts the records with a ranked item only.
    """
    last = F.size("ranks") if last_depth is None else F.least(F.size("ranks"), F.lit(last_depth))
    prefixes = F.transform(F.sequence(F.lit(first_depth), last), lambda k: F.slice(F.col("ranks"), F.lit(1), k))
    sums = (
        paths.where(F.size("ranks") >= first_depth)
        .select("bag_id", "label", "n", F.explode(prefixes).alias("prefix"))
        .groupBy("bag_id", "prefix")
        .agg(*class_sums(classes))
    )
    return sums.select(
        "bag_id",
        "prefix",
        sums_total(classes).alias("n"),
        sums_largest(classes).alias("n_max"),
        sums_squares(classes).alias("squares"),
        sums_majority(classes).alias("label"),
    )


def node_gain(nodes: DataFrame, parents: DataFrame, min_gain: float = 0.0) -> DataFrame:
    """Adds gain over the parent, `passes` (gain and minimum class count) and `pure` to each node.

    `nodes` have their bag's min_count, `parents` must contain every node's parent.
    """
    above = parents.select(
        "bag_id", F.col("prefix").alias("parent"), F.col("n").alias("n_parent"), F.col("squares").alias("sq_parent")
    )
    below = nodes.where(F.size("prefix") > 0).withColumn("parent", parent_of(F.col("prefix")))
    pair = [F.col(c) for c in ("n", "squares", "n_parent", "sq_parent")]
    return (
        below.join(above, ["bag_id", "parent"])
        .withColumn("gain", gain(*pair))
        .withColumn("passes", gain_exceeds(*pair, min_gain) & (F.col("n_max") >= F.col("min_count")))
        .withColumn("pure", F.col("n_max") == F.col("n"))
    )


def qualified_nodes(
    paths: DataFrame,
    widest: int,
    limits: DataFrame,
    classes: list,
    min_gain: float = 0.0,
    max_depth: int | None = None,
) -> DataFrame:
    """Qualified nodes, found in rounds of a few depths below the nodes that are still open."""
    deepest_level = widest if max_depth is None else min(widest, max_depth)
    found, ends, depth = [], None, 0
    while True:
        last = min(depth + DEPTHS_PER_ROUND, deepest_level)
        # A node below the minimum count can neither qualify nor lead to one that does; the root is only a parent.
        nodes = node_table(paths, classes, depth + 1 if depth else 0, last).join(F.broadcast(limits), "bag_id")
        nodes = stage(nodes.where((F.col("n_max") >= F.col("min_count")) | (F.size("prefix") == 0)), "tree-nodes")
        judged = node_gain(nodes, nodes if ends is None else nodes.unionByName(ends), min_gain)
        passing = stage(judged.where("passes").select(*nodes.columns, "pure"), "tree-passing")
        chain = _all_ancestors_open(passing, depth)
        if last >= deepest_level:
            return reduce(DataFrame.unionByName, [*found, chain])
        chain = stage(chain, "tree-qualified")
        found.append(chain)
        ends = chain.where((F.size("prefix") == last) & ~F.col("pure")).select(*nodes.columns)
        paths, seen = stage_observed(_below(paths, ends, last), "tree-paths", widest=F.max(F.size("ranks")))
        if not seen["rows"]:
            return reduce(DataFrame.unionByName, found)
        deepest_level = min(deepest_level, seen["widest"])
        depth = last


def _below(paths: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """Paths that run on below one of the nodes `ends`, all of the given depth."""
    heads = ends.select("bag_id", F.col("prefix").alias("head"))
    longer = paths.where(F.size("ranks") > depth).withColumn("head", F.slice("ranks", 1, depth))
    return longer.join(heads, ["bag_id", "head"], "left_semi").drop("head")


def _all_ancestors_open(passing: DataFrame, depth: int) -> DataFrame:
    """Passing nodes whose ancestors in this round all pass and are not pure."""
    gates = passing.where(~F.col("pure")).select("bag_id", F.col("prefix").alias("gate"))
    lengths = F.sequence(F.lit(depth), F.size("prefix") - 1)
    above = F.transform(
        F.filter(lengths, lambda k: k > depth), lambda k: F.slice(F.col("prefix"), F.lit(1), k)
    )
    climbed = (
        passing.select("bag_id", "prefix", F.explode(above).alias("gate"))
        .join(gates, ["bag_id", "gate"])
        .groupBy("bag_id", "prefix")
        .agg(F.count("*").alias("open"))
    )
    needed = F.size("prefix") - F.lit(depth + 1)
    return (
        passing.join(climbed, ["bag_id", "prefix"], "left")
        .where(F.coalesce(F.col("open"), F.lit(0)) == needed)
        .drop("open")
    )


def path_rules(paths: DataFrame, nodes: DataFrame, item_n: DataFrame) -> DataFrame:
    """(bag_id, prefix, consequent, n_ant, n_hit) of each node's rule, counted on all records holding its items.

    `item_n` is (bag_id, item, n). Each path is looked up under its rarest item, and the matches are added up before
    the shuffle.
    """
    wanted, seen = stage_observed(
        nodes.select("bag_id", "prefix", F.col("label").alias("consequent"), F.explode("prefix").alias("item"))
        .join(item_n, ["bag_id", "item"])
        .groupBy("bag_id", "prefix", "consequent")
        .agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))
        .withColumn("others", F.array_remove("prefix", F.col("anchor"))),
        "tree-rules",
        longest=F.max(F.size("others")),
        items=F.sum(F.size("others") + 1),
    )
    index = RuleIndex(wanted, seen["longest"] or 0, seen["items"] or 0)
    records = paths.select("bag_id", F.col("ranks").alias("items"), "label", "n")
    return (
        match(records, index, on=["bag_id"])
        .groupBy("bag_id", "prefix", "consequent")
        .agg(
            F.sum("n").alias("n_ant"),
            F.sum(F.when(F.col("label") == F.col("consequent"), F.col("n")).otherwise(0)).alias("n_hit"),
        )
    )


def deepest(survivors: DataFrame) -> DataFrame:
    """Rules whose path is not a strict prefix of another rule's path."""
    lengths = F.sequence(F.lit(0), F.size("prefix") - 1)
    above = F.transform(lengths, lambda k: F.slice(F.col("prefix"), F.lit(1), k))
    covered = survivors.select("bag_id", F.explode(above).alias("prefix")).distinct()
    return survivors.join(covered, ["bag_id", "prefix"], "left_anti")


def mine_gain(
    tx: DataFrame,
    min_support: float = 0.2,
    min_confidence: float = 0.5,
    min_chi2: float = 3.841,
    min_gain: float = 0.0,
    max_depth: int | None = None,
    presorted: bool = False,
    counts: DataFrame | None = None,
    map_limit: int = RANK_MAP_LIMIT,
) -> DataFrame:
    """Rules of the gain strategy. `presorted` takes the items in their given order, without ranking or dropping any."""
    counts = stage(label_counts(tx), "label-counts") if counts is None else counts
    if presorted:
        ranks = None
        paths = (
            tx.select("bag_id", distinct_items(F.col("items")).alias("ranks"), "label", weight(tx).alias("n"))
            .where(F.size("ranks") > 0)
            .groupBy("bag_id", "ranks", "label")
            .agg(F.sum("n").alias("n"))
        )
        item_n = item_counts(counts).groupBy("bag_id", "item").agg(F.sum("n").alias("n"))
        limits = bag_totals(counts).select("bag_id", min_count(F.col("n_total"), min_support).alias("min_count"))
    else:
        ranks, by_map = stage_ranks(rank_items(counts, min_support, "gain"), map_limit)
        paths = ranked_baskets(tx, ranks, by_map)
        item_n = ranks.select("bag_id", F.col("rank").alias("item"), "n")
        limits = bag_limits(ranks)
    paths, seen = stage_observed(paths, "paths", widest=F.max(F.size("ranks")))
    paths = spread(paths, seen["rows"])
    nodes = qualified_nodes(paths, seen["widest"] or 0, limits, class_list(counts), min_gain, max_depth)
    found = path_rules(paths, nodes, item_n)
    survivors = stage(keep_rules(measure(found, counts), min_confidence, min_chi2), "tree-survivors")
    rules = deepest(survivors)
    if presorted:
        return finish(rules.withColumnRenamed("prefix", "antecedent"))
    named = rules.join(items_by_rank(ranks), "bag_id")
    return finish(named.withColumn("antecedent", decode(F.col("prefix"), F.col("names"))))
