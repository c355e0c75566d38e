"""Class and item counts, item ranking by frequency or information gain, rank encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.functions.metrics import gain, gain_exceeds, gini, square
from ruleloom.staging import stage_observed

# Up to this many ranked items in a bag, the ranking travels to the records as one broadcast map per bag, which is searched
# entry by entry; beyond it the items are joined one by one. The result is the same.
RANK_MAP_LIMIT = 100


def distinct_items(items: Column) -> Column:
    """The items themselves, null items left out; a record with a repeated item is an error, one without items has none."""
    given = F.coalesce(F.array_compact(items), F.array())
    return F.when(F.size(given) == F.size(F.array_distinct(given)), given).otherwise(
        F.raise_error(F.concat(F.lit("items of a record must be unique: "), F.to_json(items)))
    )


def weight(tx: DataFrame) -> Column:
    """Records a row stands for: its `n` if the table is compacted, else one."""
    return F.col("n") if "n" in tx.columns else F.lit(1).cast("bigint")


def compact(tx: DataFrame) -> DataFrame:
    """(bag_id, items, label, n): equal records counted together, combined before the shuffle.

    Training reads its input several times; on categorical tables the compacted input is far smaller.
    """
    return tx.groupBy("bag_id", "items", "label").agg(F.sum(weight(tx)).alias("n"))


def label_counts(tx: DataFrame) -> DataFrame:
    """(bag_id, is_class, item, label, n) of every item, and where is_class the class counts, in one pass.

    The counts are combined before the shuffle, so a frequent item costs one row per task.
    """
    items = distinct_items(F.col("items"))
    each = F.transform(items, lambda i: F.struct(F.lit(False).alias("is_class"), i.alias("item")))
    total = F.struct(F.lit(True).alias("is_class"), F.get(items, F.lit(-1)).alias("item"))
    return (
        tx.select("bag_id", "label", weight(tx).alias("n"), F.explode(F.concat(F.array(total), each)).alias("of"))
        .groupBy("bag_id", "of.is_class", "of.item", "label")
        .agg(F.sum("n").alias("n"))
    )


def item_counts(counts: DataFrame) -> DataFrame:
    """(bag_id, item, label, n) from staged label counts."""
    return counts.where(~F.col("is_class")).drop("is_class")


def class_counts(counts: DataFrame) -> DataFrame:
    """(bag_id, label, n_class) from staged label counts."""
    return counts.where("is_class").select("bag_id", "label", F.col("n").alias("n_class"))


def class_list(counts: DataFrame) -> list:
    """All classes in rising order: one value per class comes to the driver."""
    return sorted(r["label"] for r in class_counts(counts).select("label").distinct().collect())


def class_sums(classes: list) -> list[Column]:
    """Records per class as columns _c0, _c1, ...: classes are few, so one aggregation by group counts them all."""
    return [F.sum(F.when(F.col("label") == F.lit(c), F.col("n")).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(classes)]


def sums_total(classes: list) -> Column:
    return sum((F.col(f"_c{i}") for i in range(1, len(classes))), F.col("_c0"))


def sums_largest(classes: list) -> Column:
    columns = [F.col(f"_c{i}") for i in range(len(classes))]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def sums_squares(classes: list) -> Column:
    squares = [square(F.col(f"_c{i}")) for i in range(len(classes))]
    return sum(squares[1:], squares[0]).cast("decimal(38,0)")


def sums_majority(classes: list) -> Column:
    """The class with most records, the smallest on ties."""
    largest = sums_largest(classes)
    return F.coalesce(*[F.when(F.col(f"_c{i}") == largest, F.lit(c)) for i, c in enumerate(classes)])


def bag_totals(counts: DataFrame) -> DataFrame:
    """(bag_id, n_total, squares, default_class, classes): size, sum of squared class counts, majority, all classes."""
    return (
        class_counts(counts)
        .groupBy("bag_id")
        .agg(
            F.sum("n_class").alias("n_total"),
            F.sum(square(F.col("n_class"))).cast("decimal(38,0)").alias("squares"),
            F.min_by("label", F.struct(-F.col("n_class"), F.col("label"))).alias("default_class"),
            F.array_sort(F.collect_set("label")).alias("classes"),
        )
    )


def class_priors(counts: DataFrame) -> DataFrame:
    """Class counts with their share of the bag and the bag's majority class."""
    totals = bag_totals(counts).select("bag_id", "n_total", "default_class")
    return class_counts(counts).join(totals, "bag_id").withColumn("prior", F.col("n_class") / F.col("n_total"))


def item_stats(counts: DataFrame) -> DataFrame:
    """Per bag and item: n, n_max (largest class count), squares, gain, and the bag's totals."""
    totals = bag_totals(counts).select("bag_id", "n_total", F.col("squares").alias("all_squares"))
    stats = (
        item_counts(counts)
        .groupBy("bag_id", "item")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("n_max"),
            F.sum(square(F.col("n"))).cast("decimal(38,0)").alias("squares"),
        )
        .join(totals, "bag_id")
    )
    ours, everyone = (F.col("n"), F.col("squares")), (F.col("n_total"), F.col("all_squares"))
    return stats.withColumn("gini", gini(*ours)).withColumn("gain", gain(*ours, *everyone))


def min_count(n_total: Column, min_support: float) -> Column:
    return F.ceil(F.lit(float(min_support)) * n_total)


def rank_items(counts: DataFrame, min_support: float, strategy: str) -> DataFrame:
    """Frequent items of each bag with `rank` 0, 1, ...

    support: by falling count, ties by rising item. gain: only items with positive gain, by falling gain, ties by
    falling item.
    """
    stats = item_stats(counts).withColumn("min_count", min_count(F.col("n_total"), min_support))
    frequent = stats.where(F.col("n") >= F.col("min_count"))
    if strategy == "gain":
        frequent = frequent.where(
            gain_exceeds(F.col("n"), F.col("squares"), F.col("n_total"), F.col("all_squares"), 0.0)
        )
        order = [F.desc(F.round("gain", 12)), F.desc("item")]
    else:
        order = [F.desc("n"), F.asc("item")]
    return frequent.withColumn("rank", F.row_number().over(W.partitionBy("bag_id").orderBy(*order)) - 1)


def stage_ranks(ranks: DataFrame, map_limit: int = RANK_MAP_LIMIT) -> tuple[DataFrame, bool]:
    """The staged ranking, and whether every bag's part of it is small enough for a map."""
    table, seen = stage_observed(ranks, "ranks", last=F.max("rank"))
    return table, (-1 if seen["last"] is None else seen["last"]) < map_limit


def bag_limits(ranks: DataFrame) -> DataFrame:
    """(bag_id, min_count) of the bags that rank any item."""
    return ranks.groupBy("bag_id").agg(F.max("min_count").alias("min_count"))


def encode_by_map(tx: DataFrame, ranks: DataFrame) -> DataFrame:
    """Look the ranks up in place, in one broadcast map per bag: no shuffle of the records.

    The found ranks pass a generator, so that a later condition on them is not pushed below and looks nothing up again.
    """
    maps = ranks.groupBy("bag_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "rank"))).alias("_rank_of"))
    found = F.array_compact(F.transform("items", lambda i: F.try_element_at(F.col("_rank_of"), i)))
    return tx.join(F.broadcast(maps), "bag_id").select("*", F.explode(F.array(found)).alias("ranks")).drop("_rank_of")


def encode_by_join(tx: DataFrame, ranks: DataFrame) -> DataFrame:
    """Join the ranks item by item and gather them per row; the rows must be distinct.

    A row without a ranked item is dropped.
    """
    return (
        tx.select("*", F.explode("items").alias("item"))
        .join(ranks.select("bag_id", "item", "rank"), ["bag_id", "item"])
        .groupBy(*tx.columns)
        .agg(F.collect_list("rank").alias("ranks"))
    )


def rank_encode(tx: DataFrame, ranks: DataFrame, by_map: bool = True, descending: bool = False) -> DataFrame:
    """Adds `ranks`, the sorted ranks of the record's ranked items; records without any are dropped.

    Without `by_map` the records must be distinct (carry their id).
    """
    encoded = (encode_by_map if by_map else encode_by_join)(tx, ranks)
    return encoded.where(F.size("ranks") > 0).withColumn("ranks", F.sort_array("ranks", asc=not descending))


def ranked_baskets(tx: DataFrame, ranks: DataFrame, by_map: bool = True, descending: bool = False) -> DataFrame:
    """(bag_id, ranks, label, n): records that look alike after rank encoding are counted together.

    Records without a ranked item are gone, but they were counted in the bag's totals.
    """
    rows = tx.select("bag_id", "items", "label", weight(tx).alias("n"))
    if not by_map and "n" not in tx.columns:
        rows = compact(tx)
    return (
        rank_encode(rows, ranks, by_map, descending)
        .groupBy("bag_id", "ranks", "label")
        .agg(F.sum("n").alias("n"))
    )


def items_by_rank(ranks: DataFrame) -> DataFrame:
    """(bag_id, names): the bag's ranked items as an array in rank order."""
    return ranks.groupBy("bag_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda e: e["item"]).alias("names")
    )


def decode(ranks_col: Column, names: Column) -> Column:
    return F.transform(ranks_col, lambda r: F.get(names, r))


def select_positions(tx: DataFrame, counts: DataFrame, keep: int = 10) -> DataFrame:
    """Cut every record to the `keep` item positions of highest information gain (ties: the lower position)."""
    totals = bag_totals(counts).select("bag_id", "n_total", F.col("squares").alias("all_squares"))
    by_position = (
        tx.select("bag_id", "label", F.posexplode("items").alias("pos", "item"))
        .groupBy("bag_id", "pos", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("bag_id", "pos")
        .agg(F.sum("n").alias("n"), F.sum(square(F.col("n"))).alias("squares"))
        .join(totals, "bag_id")
        .withColumn("gain", gain(F.col("n"), F.col("squares"), F.col("n_total"), F.col("all_squares")))
    )
    best = W.partitionBy("bag_id").orderBy(F.desc(F.round("gain", 12)), F.asc("pos"))
    kept = (
        by_position.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= keep)
        .groupBy("bag_id")
        .agg(F.collect_set("pos").alias("_kept"))
    )
    chosen = F.filter("items", lambda _, i: F.array_contains(F.col("_kept"), i))
    return tx.join(F.broadcast(kept), "bag_id").withColumn("items", chosen).drop("_kept")
