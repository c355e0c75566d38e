"""Database coverage: keep the rules that classify some record not yet claimed by a better rule.

In rule order, over the records that remain: a rule that applies to no record is spare; one that is right for at
least one of its records is used, and claims all of them; any other is harmful and dropped.

Read as a fixpoint this needs no loop over rules. Records with the same applicable rules and the same rights and wrongs
are one pattern, an array of codes in rule order. In each round, all bags at once:

* a rule not right in any open pattern can no longer be used and leaves the patterns;
* a rule that comes first in some pattern and is right there is used;
* patterns are cut behind their first used rule, and are closed when nothing stands before it.

At least the best undecided rule of every bag is decided per round. Afterwards a rule that is not used is harmful if it
stands before the first used rule of some original pattern, else spare.

The rules come in blocks, each several times as long as the one before. A block meets only the records that no better block
has claimed, so a record is held against few rules more than those before the one that claims it, and its list of matches is never longer than
one block. When no record is left, all further rules are spare without having been matched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.operators.match import RuleIndex, index_rules, match
from ruleloom.staging import spread, stage, stage_observed

USED, SPARE = 1, 2
# The states of this many rules, one number each, are broadcast to the patterns; more are joined by bag and place.
STATE_LIMIT = 5_000_000
# Rules of a bag in the first block, and how many times longer each further block is.
FIRST_BLOCK, GROWTH = 256, 8


def _code(place: Column, right: Column) -> Column:
    """Place in rule order and rightness in one number that sorts by place."""
    return place * 2 + F.when(right, 0).otherwise(1)


def _place(code: Column) -> Column:
    return F.shiftright(code, 1)


def _right(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 0


def _blocks(last: int) -> Iterator[tuple[int, int]]:
    """(before, last) places of each block of rules, up to `last`."""
    before, size = 0, FIRST_BLOCK
    while before < last:
        yield before, min(before + size, last)
        before, size = before + size, size * GROWTH


def _block_indexes(index: RuleIndex, blocks: list[tuple[int, int]]) -> list[RuleIndex]:
    """The index cut into blocks, each with its own count of items; one row per block comes to the driver."""
    if len(blocks) < 2:
        return [index] * len(blocks)
    number = F.lit(0)
    for k, (before, _) in enumerate(blocks):
        number = F.when(F.col("place") > before, k).otherwise(number)
    counted = index.table.groupBy(number.alias("block")).agg(F.sum(F.size("others") + 1).alias("items"))
    items = {r["block"]: r["items"] for r in counted.collect()}
    within = [(F.col("place") > before) & (F.col("place") <= to) for before, to in blocks]
    return [replace(index, table=index.table.where(w), items=items.get(k, 0)) for k, w in enumerate(within)]


def _records(tx: DataFrame, shared: bool) -> DataFrame:
    """(_rec, items, label), with bag_id unless shared: equal records once (compacted input has none). To be staged, so that `_rec` stays."""
    own = [] if shared else ["bag_id"]
    records = tx.select(*own, "items", "label")
    if shared or "n" not in tx.columns:
        records = records.distinct()
    return records.withColumn("_rec", F.monotonically_increasing_id())


def _hits(records: DataFrame, index: RuleIndex, before: int) -> DataFrame:
    """(bag_id, _rec, codes): the rules of one block that apply to each record, places counted from the block's begin.

    Records without bag_id are held against the rules of all bags.
    """
    hits = match(records, index, on=[c for c in records.columns if c == "bag_id"])
    code = _code(F.col("place") - before, F.col("label") == F.col("consequent"))
    return hits.groupBy("bag_id", "_rec").agg(F.array_sort(F.collect_list(code)).alias("codes"))


def _unclaimed(records: DataFrame, hits: DataFrame, used: DataFrame, bags: DataFrame) -> DataFrame:
    """The records of `bags` to which no used rule of the block applies; records without bag_id go to each of `bags`."""
    if "bag_id" in records.columns:
        open_ = records.join(bags, "bag_id", "left_semi")
    else:  # one value per bag comes to the driver
        values = [F.lit(r["bag_id"]).cast(bags.schema["bag_id"].dataType) for r in bags.collect()]
        open_ = records.withColumn("bag_id", F.explode(F.array(*values)))
    taken = hits.select("bag_id", "_rec", F.explode("codes").alias("code")).withColumn("place", _place(F.col("code")))
    claimed = taken.join(used, ["bag_id", "place"], "left_semi").select("bag_id", "_rec").distinct()
    return open_.join(claimed, ["bag_id", "_rec"], "left_anti")


def _marked(patterns: DataFrame, places: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """(bag_id, marked): the patterns as arrays of (code, state), state 0 where `facts` (bag_id, place, state) has none.

    A few states travel to the patterns as one broadcast array per bag; more are joined code by code on bag and place.
    """
    if few:
        entry = F.struct("place", F.coalesce("state", F.lit(0)).alias("state"))
        filled = places.join(facts, ["bag_id", "place"], "left").groupBy("bag_id")
        states = filled.agg(F.array_sort(F.collect_list(entry)).alias("known")).select(
            "bag_id", F.transform("known", lambda e: e["state"]).alias("states")
        )
        known = F.transform("codes", lambda c: F.struct(c.alias("code"), F.get("states", _place(c) - 1).alias("state")))
        return patterns.join(F.broadcast(states), "bag_id").select("bag_id", known.alias("marked"))
    cells = patterns.select("bag_id", "codes", F.posexplode("codes").alias("at", "code")).withColumn("place", _place(F.col("code")))
    found = cells.join(facts.select("bag_id", "place", "state"), ["bag_id", "place"], "left")
    cell = F.struct("at", "code", F.coalesce("state", F.lit(0)).alias("state"))
    gathered = found.groupBy("bag_id", "codes").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return gathered.select("bag_id", F.transform("cells", lambda c: F.struct(c["code"], c["state"])).alias("marked"))


def _before_used(marked: Column) -> Column:
    """What stands before the first used rule."""
    at = F.array_position(F.transform(marked, lambda m: m["state"] == 2), True)
    return F.when(at == 0, marked).otherwise(F.slice(marked, F.lit(1), (at - 1).cast("int")))


def _round_facts(open_patterns: DataFrame) -> DataFrame:
    """(bag_id, place, state): 2 = used now, 1 = still right somewhere, 0 = right nowhere any more."""
    code = F.col("code")
    state = F.when(_right(code), F.when(F.col("at") == 0, 2).otherwise(1)).otherwise(0)
    return (
        open_patterns.select("bag_id", F.posexplode("codes").alias("at", "code"))
        .groupBy("bag_id", _place(code).alias("place"))
        .agg(F.max(state).alias("state"))
    )


def _next_round(still_open: DataFrame, places: DataFrame, few: bool) -> DataFrame:
    """The patterns left open, reduced to the rules that are still undecided in them."""
    possible = F.filter(_before_used(F.col("marked")), lambda m: m["state"] > 0)
    return (
        _marked(still_open, places, _round_facts(still_open), few)
        .select("bag_id", F.transform(possible, lambda m: m["code"]).alias("codes"))
        .where(F.size("codes") > 0)
        .distinct()
    )


def used_rules(patterns: DataFrame, places: DataFrame, few: bool = True) -> DataFrame:
    """(bag_id, place) of the used rules; rounds until no pattern is open."""
    rounds, still_open, seen = [patterns], patterns, {"rows": 1}
    while seen["rows"]:
        still_open, seen = stage_observed(_next_round(still_open, places, few), "coverage-open")
        rounds.append(still_open)
    first = F.col("codes")[0]
    return (
        reduce(DataFrame.unionByName, rounds)
        .where(_right(first))
        .select("bag_id", _place(first).alias("place"))
        .distinct()
    )


def _harmful(patterns: DataFrame, places: DataFrame, used: DataFrame, few: bool) -> DataFrame:
    """(bag_id, place) of what stands before the first used rule of some pattern."""
    marked = _marked(patterns, places, used.withColumn("state", F.lit(2)), few)
    before = marked.select("bag_id", F.explode(_before_used(F.col("marked"))).alias("m"))
    return before.select("bag_id", _place(F.col("m.code")).alias("place")).distinct()


def cover(
    rules: DataFrame, tx: DataFrame, save_spare: bool = True, shared: bool = False, facts: list[dict] | None = None
) -> DataFrame:
    """Level 1 of `rules` split into used (level 1) and spare (level 2) by coverage of `tx`; harmful rules are gone.

    `tx` carries bag_id, unless `shared`: then all bags are covered on the same records. `facts`, if given, gets a row for
    each block of rules: its last place, the records held against it, and the matches found.
    """
    by_rank = W.partitionBy("bag_id").orderBy("rank")
    ordered, seen = stage_observed(
        rules.where(F.col("level") == 1).withColumn("place", F.row_number().over(by_rank)), "coverage-rules", last=F.max("place")
    )
    blocks = list(_blocks(seen["last"] or 0))
    indexes = _block_indexes(index_rules(ordered, ["bag_id", "place"], ["consequent"]), blocks)
    records, open_ = stage_observed(_records(tx, shared), "coverage-records")
    used_parts, harmful_parts = [], []
    for (before, to), index in zip(blocks, indexes, strict=True):
        if not open_["rows"]:
            break
        few = index.items <= STATE_LIMIT
        places = ordered.where((F.col("place") > before) & (F.col("place") <= to)).select("bag_id", (F.col("place") - before).alias("place"))
        hits, met = stage_observed(_hits(spread(records, open_["rows"]), index, before), "coverage-hits", matches=F.sum(F.size("codes")))
        if facts is not None:
            facts.append({"to": to, "records": open_["rows"], "matches": met["matches"] or 0})
        patterns, found = stage_observed(hits.select("bag_id", "codes").distinct(), "coverage-patterns")
        patterns = spread(patterns, found["rows"])
        used = stage(used_rules(patterns, places, few), "coverage-used")
        used_parts.append(used.withColumn("place", F.col("place") + before))
        if save_spare:
            harmful_parts.append(_harmful(patterns, places, used, few).withColumn("place", F.col("place") + before))
        if to < blocks[-1][1]:
            bags = ordered.where(F.col("place") > to).select("bag_id").distinct()
            records, open_ = stage_observed(_unclaimed(records, hits, used, bags), "coverage-records")
    none = ordered.select("bag_id", "place").limit(0)
    used = reduce(DataFrame.unionByName, used_parts, none)
    split = ordered.join(used.withColumn("_used", F.lit(True)), ["bag_id", "place"], "left")
    split = split.withColumn("level", F.when(F.col("_used"), USED).otherwise(SPARE)).drop("_used")
    if not save_spare:
        return split.where(F.col("level") == USED).drop("place")
    harmful = reduce(DataFrame.unionByName, harmful_parts, none)
    return split.join(harmful, ["bag_id", "place"], "left_anti").drop("place")


def flatten_levels(covered: DataFrame) -> DataFrame:
    """One list per bag: used rules, then spare ones, ranked anew."""
    order = W.partitionBy("bag_id").orderBy("level", "rank")
    return covered.withColumn("rank", F.row_number().over(order)).withColumn("level", F.lit(1))
