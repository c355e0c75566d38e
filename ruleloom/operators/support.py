"""Rules from frequent itemsets, for all bags at once.

Records are first reduced to weighted baskets of ranked items. If all baskets are narrow and have
few subsets, these are counted in one aggregation. With more of them, items and pairs are counted first, and then all larger
subsets in a second aggregation: a subset is grown only by items that form a frequent pair with
each of its items, so none that holds an infrequent pair is ever written. Otherwise, or with too many frequent pairs, itemsets grow level by level over the projected data: (bag_id, itemset, rest, label, n), where
`rest` are the items that may still extend the itemset in those records, rarest first. Each level counts the
extensions per class (combined before the shuffle), keeps the frequent ones, and projects the data on them: rests shrink
to frequent extensions and equal rows are added up, so that data and lineage both shrink. Every level is staged.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.items import (
    RANK_MAP_LIMIT,
    bag_limits,
    class_counts,
    class_list,
    class_sums,
    decode,
    items_by_rank,
    label_counts,
    min_count,
    rank_items,
    ranked_baskets,
    stage_ranks,
    sums_largest,
    sums_total,
)
from ruleloom.operators.rules import finish, keep_rules, measure
from ruleloom.staging import spread, stage, stage_observed

# All subsets of a basket are counted at once if none is wider than this and the mean number of subsets is bounded; up to the
# second bound pairs are counted first. The result is the same.
NARROW = 16
MEAN_SUBSETS = 64
PAIRED_SUBSETS = 512
# Frequent pairs of all bags together, up to which they travel to the baskets by broadcast.
PAIR_LIMIT = 1_000_000


def subset_counts(widest: int, max_length: int) -> list[int]:
    """Number of subsets of 1 to max_length items of a basket of 0, 1, ... widest items."""
    return [sum(comb(w, k) for k in range(1, min(w, max_length) + 1)) for w in range(widest + 1)]


def frequent_itemsets(
    tx: DataFrame,
    min_support: float,
    max_length: int = 10,
    suffix_predicate: Column | None = None,
    counts: DataFrame | None = None,
    map_limit: int = RANK_MAP_LIMIT,
    narrow: int = NARROW,
    pair_limit: int = PAIR_LIMIT,
    at_once: int = MEAN_SUBSETS,
) -> tuple[DataFrame, DataFrame]:
    """Itemsets whose largest class count reaches the minimum count of their bag.

    Returns (itemsets, names): itemsets is (bag_id, itemset array of ranks, label, n_hit, n_ant, n_max), one row per
    class; names decodes ranks. Itemsets list their rarest item first. A `suffix_predicate` over column `item` is
    tested on that rarest item only.
    """
    counts = stage(label_counts(tx), "label-counts") if counts is None else counts
    classes = class_list(counts)
    ranks, by_map = stage_ranks(rank_items(counts, min_support, "support"), map_limit)
    usable = ranks.where(F.col("n_max") >= F.col("min_count"))
    limits = bag_limits(ranks)
    baskets, width = stage_observed(
        ranked_baskets(tx, usable, by_map, descending=True),
        "baskets",
        widest=F.max(F.size("ranks")),
        subsets=F.sum(F.get(F.array(*map(F.lit, subset_counts(narrow, max_length))), F.size("ranks"))),
    )
    baskets = spread(baskets, width["rows"])
    starts = None if suffix_predicate is None else usable.where(suffix_predicate).select("bag_id", "rank")
    is_narrow, subsets = (width["widest"] or 0) <= narrow, width["subsets"] or 0
    if is_narrow and subsets <= at_once * width["rows"]:
        return _all_subsets(baskets, limits, classes, max_length, starts), items_by_rank(ranks)
    if is_narrow and subsets <= PAIRED_SUBSETS * width["rows"]:
        found = _pairs_first(baskets, ranks, limits, classes, max_length, starts, pair_limit)
        return found, items_by_rank(ranks)
    return _level_by_level(baskets, limits, classes, max_length, starts), items_by_rank(ranks)


def _from_start(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Only itemsets whose first item is among `starts`."""
    if starts is None:
        return rows
    heads = starts.select("bag_id", F.array("rank").alias("head"))
    return rows.withColumn("head", F.slice("itemset", 1, 1)).join(heads, ["bag_id", "head"], "left_semi").drop("head")


def _all_subsets(
    baskets: DataFrame, limits: DataFrame, classes: list, max_length: int, starts: DataFrame | None
) -> DataFrame:
    empty = F.array(F.array().cast("array<int>"))

    def grow(sets: Column, x: Column) -> Column:
        open_sets = F.filter(sets, lambda s: F.size(s) < max_length)
        return F.concat(sets, F.transform(open_sets, lambda s: F.concat(s, F.array(x))))

    subsets = F.filter(F.aggregate("ranks", empty, grow), lambda s: F.size(s) > 0)
    rows = baskets.select("bag_id", F.explode(subsets).alias("itemset"), "label", "n")
    return _frequent(_from_start(rows, starts), limits, classes)


def _pairs_first(
    baskets: DataFrame,
    ranks: DataFrame,
    limits: DataFrame,
    classes: list,
    max_length: int,
    starts: DataFrame | None,
    pair_limit: int,
) -> DataFrame:
    short = _frequent(short_subsets(baskets, max_length), limits, classes)
    short, seen = stage_observed(short, "short-itemsets", pairs=F.count_if(F.size("itemset") == 2))
    if max_length < 3 or not seen["pairs"]:
        return _from_start(short, starts)
    if seen["pairs"] > pair_limit:
        return _level_by_level(baskets, limits, classes, max_length, starts)
    larger = larger_subsets(baskets, partners(ranks, short), max_length)
    return _from_start(short, starts).unionByName(_frequent(_from_start(larger, starts), limits, classes))


def short_subsets(baskets: DataFrame, max_length: int) -> DataFrame:
    """(bag_id, itemset, label, n) of every item, and of every pair if `max_length` allows pairs."""
    later = F.transform("ranks", lambda x, i: F.transform(F.slice("ranks", i + 2, F.size("ranks")), lambda y: F.array(x, y)))
    subsets = F.transform("ranks", lambda x: F.array(x))
    if max_length > 1:
        subsets = F.concat(subsets, F.flatten(later))
    return baskets.select("bag_id", F.explode(subsets).alias("itemset"), "label", "n")


def partners(ranks: DataFrame, short: DataFrame) -> DataFrame:
    """(bag_id, partners): for each rank of the bag, in order, the items after it in a frequent pair; one row per bag."""
    first, second = F.get("itemset", F.lit(0)).alias("rank"), F.get("itemset", F.lit(1))
    pairs = short.where(F.size("itemset") == 2).groupBy("bag_id", first).agg(F.collect_set(second).alias("after"))
    entry = F.struct("rank", F.coalesce("after", F.array().cast("array<int>")).alias("after"))
    every = ranks.select("bag_id", "rank").join(pairs, ["bag_id", "rank"], "left")
    in_order = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["after"])
    return every.groupBy("bag_id").agg(in_order.alias("partners"))


def larger_subsets(baskets: DataFrame, known: DataFrame, max_length: int) -> DataFrame:
    """(bag_id, itemset, label, n) of the subsets of three and more items all of whose pairs are frequent.

    `open` holds the items that may still extend a subset. The table of pairs is broadcast, its size was counted before.
    """
    empty = F.array().cast("array<struct<itemset:array<int>,open:array<int>>>")

    def grow(sets: Column, x: Column) -> Column:
        after = F.get("partners", x)
        able = F.filter(sets, lambda s: (F.size(s["itemset"]) < max_length) & F.array_contains(s["open"], x))
        grown = F.transform(
            able,
            lambda s: F.struct(
                F.concat(s["itemset"], F.array(x)).alias("itemset"), F.array_intersect(s["open"], after).alias("open")
            ),
        )
        alone = F.struct(F.array(x).alias("itemset"), F.array_intersect(F.col("ranks"), after).alias("open"))
        return F.concat(sets, grown, F.array(alone))

    sets = F.filter(F.aggregate("ranks", empty, grow), lambda s: F.size(s["itemset"]) > 2)
    wide = baskets.where(F.size("ranks") > 2).join(F.broadcast(known), "bag_id")
    return wide.select("bag_id", F.explode(sets).alias("s"), "label", "n").select("bag_id", "s.itemset", "label", "n")


def _level_by_level(
    baskets: DataFrame, limits: DataFrame, classes: list, max_length: int, starts: DataFrame | None
) -> DataFrame:
    front = baskets.select(
        "bag_id", F.array().cast("array<int>").alias("itemset"), F.col("ranks").alias("rest"), "label", "n"
    )
    levels = []
    for _ in range(max_length):
        if levels:
            front, seen = stage_observed(_from_start(_project(front, _extensions(levels[-1])), starts), "projected")
            front = spread(front, seen["rows"])
        rows = front.select(
            "bag_id", F.explode("rest").alias("x"), "itemset", "label", "n"
        ).select("bag_id", F.concat("itemset", F.array("x")).alias("itemset"), "label", "n")
        found, seen = stage_observed(_frequent(rows, limits, classes), "itemsets")
        levels.append(found)
        if not seen["rows"]:
            break
    return _from_start(reduce(DataFrame.unionByName, levels), starts)


def _frequent(rows: DataFrame, limits: DataFrame, classes: list) -> DataFrame:
    """Class counts of each itemset whose largest class count reaches the bag's minimum."""
    sets = (
        rows.groupBy("bag_id", "itemset")
        .agg(*class_sums(classes))
        .withColumn("n_ant", sums_total(classes))
        .withColumn("n_max", sums_largest(classes))
        .join(F.broadcast(limits), "bag_id")
        .where(F.col("n_max") >= F.col("min_count"))
    )
    per_class = F.array(
        *[F.struct(F.lit(c).alias("label"), F.col(f"_c{i}").alias("n_hit")) for i, c in enumerate(classes)]
    )
    return sets.select("bag_id", "itemset", "n_ant", "n_max", F.inline(per_class)).where(F.col("n_hit") > 0)


def _extensions(found: DataFrame) -> DataFrame:
    """(bag_id, itemset, x): x extends itemset to a frequent one."""
    parent = F.slice("itemset", 1, F.size("itemset") - 1)
    return found.select("bag_id", parent.alias("itemset"), F.element_at("itemset", -1).alias("x")).distinct()


def _project(front: DataFrame, extensions: DataFrame) -> DataFrame:
    """Move every row on to each of its frequent extensions that leaves a rest."""
    allowed = extensions.groupBy("bag_id", "itemset").agg(F.collect_set("x").alias("allowed"))
    return (
        front.join(allowed, ["bag_id", "itemset"])
        .withColumn("rest", F.array_intersect("rest", "allowed"))
        .where(F.size("rest") > 1)
        .select("bag_id", "itemset", "rest", "label", "n", F.posexplode("rest").alias("at", "x"))
        .where(F.col("at") < F.size("rest") - 1)
        .select(
            "bag_id",
            F.concat("itemset", F.array("x")).alias("itemset"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
            "label",
            "n",
        )
        .groupBy("bag_id", "itemset", "rest", "label")
        .agg(F.sum("n").alias("n"))
    )


def mine_support(
    tx: DataFrame,
    min_support: float = 0.2,
    min_confidence: float = 0.5,
    min_chi2: float = 3.841,
    max_length: int = 10,
    filter_singletons: bool = False,
    suffix_predicate: Column | None = None,
    counts: DataFrame | None = None,
    map_limit: int = RANK_MAP_LIMIT,
    narrow: int = NARROW,
    pair_limit: int = PAIR_LIMIT,
    at_once: int = MEAN_SUBSETS,
) -> DataFrame:
    """Rules itemset -> class for each class that attains the itemset's largest class count.

    One-item rules are not held to the confidence and chi-square bounds unless `filter_singletons`.
    """
    counts = stage(label_counts(tx), "label-counts") if counts is None else counts
    itemsets, names = frequent_itemsets(
        tx, min_support, max_length, suffix_predicate, counts, map_limit, narrow, pair_limit, at_once
    )
    found = _candidates(itemsets.where(F.col("n_hit") == F.col("n_max")), names)
    exempt = None if filter_singletons else F.size("antecedent") == 1
    return finish(keep_rules(measure(found, counts), min_confidence, min_chi2, exempt))


def mine_class_tokens(
    tx: DataFrame,
    min_support: float = 0.2,
    min_confidence: float = 0.5,
    min_chi2: float = 3.841,
    max_length: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Whole-table variant: rules for every class whose own count with the itemset reaches the minimum.

    As if each record carried its class as one more item: all rules are filtered, length is not bounded unless asked.
    """
    counts = stage(label_counts(tx), "label-counts") if counts is None else counts
    if max_length is None:
        max_length = tx.agg(F.max(F.size("items")).alias("w")).first()["w"] or 0
    itemsets, names = frequent_itemsets(tx, min_support, max_length, counts=counts)
    bag_size = class_counts(counts).groupBy("bag_id").agg(F.sum("n_class").alias("n_total"))
    reached = itemsets.join(bag_size, "bag_id").where(F.col("n_hit") >= min_count(F.col("n_total"), min_support))
    return finish(keep_rules(measure(_candidates(reached, names), counts), min_confidence, min_chi2))


def _candidates(itemsets: DataFrame, names: DataFrame) -> DataFrame:
    antecedent = decode(F.col("itemset"), F.col("names")).alias("antecedent")
    return itemsets.join(names, "bag_id").select(
        "bag_id", antecedent, F.col("label").alias("consequent"), "n_ant", "n_hit"
    )
