"""Classify records with rule tables: first match, weighted votes, majority of bags.

Equal item sets are scored once: one match join and one shuffle of one small row per distinct set, however many rules and
bags apply to it. The results are joined back on the items, so every record keeps its row, whatever its id. Item sets that
many records share are joined back by broadcast, where no task has all their records.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.match import BROADCAST_ITEMS, RuleIndex, index_rules, match
from ruleloom.staging import stage_observed

VOTINGS = ("max", "mean", "min")
METRICS = ("support", "confidence")
WEIGHTS = ("none", "numRules")
# A set on more than this many rows, and on more than a shuffle partition's mean, is joined back by broadcast.
HOT_ROWS = 10_000


@dataclass(frozen=True)
class VoteSettings:
    """How matching rules vote. The metric support votes with 1 - support.

    Unknown values are errors; with `compat` they fall back to max, confidence, and no weight.
    """

    voting: str = "max"
    metric: str = "support"
    weight: str = "none"
    compat: bool = False

    def __post_init__(self) -> None:
        for name, known in (("voting", VOTINGS), ("metric", METRICS), ("weight", WEIGHTS)):
            if getattr(self, name) not in known and not self.compat:
                raise ValueError(f"{name} must be one of {known}, got {getattr(self, name)!r}")

    @property
    def shares_rest(self) -> bool:
        """Only max votes of confidence without weight split the rest among the classes without a vote."""
        return (self.voting, self.metric, self.weight) == ("max", "confidence", "none")

    @property
    def way(self) -> str:
        """How votes are combined, by name: settings that differ in weight alone have the same votes."""
        return f"{self.voting}_{self.metric}"

    def vote(self) -> Column:
        return 1.0 - F.col("support") if self.metric == "support" else F.col("confidence")

    def combine(self, votes: Column) -> Column:
        return {"mean": F.avg, "min": F.min}.get(self.voting, F.max)(votes)


def uniform_proba(classes: Sequence[object]) -> list[float]:
    return [1.0 / len(classes)] * len(classes)


def class_array(classes: Sequence[object]) -> Column:
    """The classes as one literal, however many there are."""
    kinds = {type(c) for c in classes}
    if kinds == {str}:
        return F.from_json(F.lit(json.dumps(list(classes))), "array<string>")
    if kinds == {int}:
        kind = "int" if all(-(2**31) <= c < 2**31 for c in classes) else "bigint"
        return F.from_json(F.lit(json.dumps(list(classes))), f"array<{kind}>")
    return F.array(*[F.lit(c) for c in classes])


def class_index(label: Column, classes: Sequence[object]) -> Column:
    """0-based position of a label among the classes, -1 if it is none of them."""
    return (F.array_position(class_array(classes), label) - 1).cast("int")


def class_at(index: Column, classes: Sequence[object]) -> Column:
    return F.get(class_array(classes), index)


def per_item_set(
    tx: DataFrame, id_cols: Sequence[str], model: Sequence[str], score: Callable[[DataFrame, list[str]], DataFrame]
) -> DataFrame:
    """`score` the distinct item sets of `tx` (of each model) and give every row of `tx` its result.

    score(sets, keys) gets rows with `keys` and items, and returns one row for each. Rows are kept as they are: equal and
    null ids, and null items, keep their rows.

    The sets are counted as they are found. Those on more rows than a shuffle partition has on average are fewer than the
    partitions, so their results are broadcast to their rows; only rows of other sets are shuffled to meet their results.
    """
    keys = ["set_of_items", *model]
    counted = tx.groupBy(*model, F.col("items").alias("set_of_items")).agg(F.count("*").alias("_n"))
    sets, seen = stage_observed(counted, "item-sets", total=F.sum("_n"), largest=F.max("_n"))
    sets = sets.withColumn("items", F.col("set_of_items"))
    partitions = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT_ROWS, (seen["total"] or 0) // partitions)
    hot = F.col("_n") > most
    left = tx.select(*id_cols, F.col("items").alias("set_of_items"), *[m for m in model if m not in id_cols]).alias("l")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))

    def joined(rows: DataFrame, scored: DataFrame, how: str) -> DataFrame:
        wanted = [c for c in scored.columns if c not in keys]
        return rows.join(scored.alias("r"), same, how).select(*[F.col(f"l.{c}") for c in id_cols], *[F.col(f"r.{c}") for c in wanted])

    if (seen["largest"] or 0) <= most:
        return joined(left, score(sets.drop("_n"), keys), "left")
    heavy = sets.where(hot)
    others = left.join(F.broadcast(heavy.select(*keys)).alias("r"), same, "left_anti").alias("l")
    shared = joined(left, F.broadcast(score(heavy.drop("_n"), keys)), "inner")
    return shared.unionByName(joined(others, score(sets.where(~hot).drop("_n"), keys), "left"))


def scoring_index(
    rules: DataFrame,
    classes: Sequence[object],
    levels: Sequence[int] = (1, 2),
    model: Sequence[str] = (),
    broadcast_items: int = BROADCAST_ITEMS,
) -> RuleIndex:
    """Rules ready for scoring. `model` columns tell models apart that score different records, e.g. folds."""
    ci = class_index(F.col("consequent"), classes)
    unknown = F.raise_error(F.concat(F.lit("rule for a class not in classes: "), F.col("consequent").cast("string")))
    chosen = rules.where(F.col("level").isin(*levels)).withColumn("ci", F.when(ci >= 0, ci).otherwise(unknown))
    return index_rules(chosen, [*model, "bag_id", "level", "rank"], ["ci", "confidence"], broadcast_items)


def matches(
    tx: DataFrame, index: RuleIndex, id_cols: Sequence[str], model: Sequence[str] = (), how: str = "left"
) -> DataFrame:
    return match(tx.select(*id_cols, *[m for m in model if m not in id_cols], "items"), index, on=model, how=how)


def bag_matches(tx: DataFrame, index: RuleIndex, id_cols: Sequence[str], model: Sequence[str] = ()) -> DataFrame:
    """Matches to be grouped by record and bag, then by record.

    Records are spread by id before they meet the broadcast rules: one shuffle of a row per record, after which
    both groupings are local, instead of a shuffle of a row per record and bag.
    """
    return matches(tx.repartition(*id_cols) if index.small else tx, index, id_cols, model)


def rule_matches(tx: DataFrame, rules: DataFrame, classes: Sequence[object], id_col: str = "rec_id") -> DataFrame:
    """(id, bag_id, level, rank) of every rule that applies to a record."""
    index = scoring_index(rules, classes)
    return matches(tx, index, [id_col], how="inner").select(id_col, "bag_id", "level", "rank")


# --- first match -----------------------------------------------------------------------------------------------


def _first_class(n_classes: int) -> Column:
    """The class number of the first match: level, rank and class in one number, its minimum, the class in the low bits.

    The class takes as many bits as there are classes, the rank has the others up to bit 56.
    """
    bits = max(1, (n_classes - 1).bit_length())
    level, rank, ci = (F.col(c).cast("bigint") for c in ("level", "rank", "ci"))
    key = F.shiftleft(level, 56) + F.shiftleft(rank, bits) + ci
    return F.min(key).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("ci")


def first_match(
    tx: DataFrame,
    rules: DataFrame,
    classes: Sequence[object],
    default_class: object = None,
    id_cols: Sequence[str] = ("rec_id",),
    model: Sequence[str] = (),
) -> DataFrame:
    """`prediction` of the first applying rule, level 1 before level 2; without any, the default class."""
    index = scoring_index(rules, classes, model=model)

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        best = matches(sets, index, keys, model).groupBy(*keys).agg(_first_class(len(classes)))
        return best.select(*keys, F.coalesce(class_at(F.col("ci"), classes), F.lit(default_class)).alias("prediction"))

    return per_item_set(tx, id_cols, model, score)


# --- votes -----------------------------------------------------------------------------------------------------


def _vote_aggregates(classes: Sequence[object], settings: Sequence[VoteSettings]) -> list[Column]:
    """Per class the number of rules `_n*`, and the votes `_v*` of each way in which the settings combine a metric."""
    counts = [F.count(F.when(F.col("ci") == i, 1)).alias(f"_n{i}") for i in range(len(classes))]
    ways = {s.way: s for s in settings}
    return counts + [
        s.combine(F.when(F.col("ci") == i, s.vote())).alias(f"_v{way}_{i}") for way, s in ways.items() for i in range(len(classes))
    ]


def _with_probability(
    votes: DataFrame, classes: Sequence[object], settings: VoteSettings, default: Sequence[float], target: str = "probability"
) -> DataFrame:
    """Add `target`, an array in class order, from the per-class votes `_v*` and rule counts `_n*`."""
    k = range(len(classes))
    vote = [F.col(f"_v{settings.way}_{i}") for i in k]
    fixed = F.array(*[F.lit(float(p)) for p in default])
    n_rules = sum((F.col(f"_n{i}") for i in k), F.lit(0))
    n_missing = sum((v.isNull().cast("int") for v in vote), F.lit(0))
    rest = F.lit(1.0)
    for v in vote:
        rest = rest * (1.0 - F.coalesce(v, F.lit(0.0)))
    if settings.shares_rest:
        rest = rest / F.when(n_missing == 0, 1).otherwise(n_missing)
    kept = votes.columns
    votes = votes.withColumn("_rules", n_rules).withColumn("_rest", rest)

    def share(i: int) -> Column:
        weighted = vote[i]
        if settings.weight == "numRules":
            weighted = F.try_divide(F.col(f"_n{i}"), F.col("_rules")) * weighted
        return F.coalesce(weighted, F.col("_rest"))

    votes = votes.withColumns({f"_s{i}": share(i) for i in k})
    votes = votes.withColumn("_sum", sum((F.col(f"_s{i}") for i in k), F.lit(0.0)))
    shares = F.array(*[F.try_divide(F.col(f"_s{i}"), F.col("_sum")) for i in k])
    return votes.withColumn(target, F.when(F.col("_rules") == 0, fixed).otherwise(shares)).select(*kept, target)


def most_probable(probability: Column) -> Column:
    """0-based position of the largest probability; the first one wins ties."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def probabilities(
    tx: DataFrame,
    rules: DataFrame,
    classes: Sequence[object],
    settings: VoteSettings | None = None,
    default_proba: Sequence[float] | None = None,
    id_cols: Sequence[str] = ("rec_id",),
    model: Sequence[str] = (),
    broadcast_items: int = BROADCAST_ITEMS,
) -> DataFrame:
    """`probability` array by the votes of the applying level-1 rules; without any, the default probabilities."""
    scored = grid_probabilities(tx, rules, classes, [settings or VoteSettings()], default_proba, id_cols, model, broadcast_items)
    return scored.withColumn("probability", F.get("probabilities", F.lit(0))).drop("probabilities")


def grid_probabilities(
    tx: DataFrame,
    rules: DataFrame,
    classes: Sequence[object],
    settings: Sequence[VoteSettings],
    default_proba: Sequence[float] | None = None,
    id_cols: Sequence[str] = ("rec_id",),
    model: Sequence[str] = (),
    broadcast_items: int = BROADCAST_ITEMS,
) -> DataFrame:
    """`probabilities`: the probability arrays under each of `settings`, in their order, from one match of the rules.

    All settings are aggregated together: the votes of each metric and way to combine them once, the rule counts once.
    """
    index = scoring_index(rules, classes, (1,), model, broadcast_items)
    default = default_proba or uniform_proba(classes)
    names = [f"_p{k}" for k in range(len(settings))]

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        votes = matches(sets, index, keys, model).groupBy(*keys).agg(*_vote_aggregates(classes, settings))
        for name, one in zip(names, settings, strict=True):
            votes = _with_probability(votes, classes, one, default, name)
        return votes.select(*keys, F.array(*names).alias("probabilities"))

    return per_item_set(tx, id_cols, model, score)


def vote_predict(scored: DataFrame, classes: Sequence[object]) -> DataFrame:
    return scored.withColumn("prediction", class_at(most_probable(F.col("probability")), classes))


# --- ensembles -------------------------------------------------------------------------------------------------


def ensemble_default(bags: DataFrame, preferred: object = None) -> object:
    """The preferred class, else the majority of the bags' default classes (ties: the smallest)."""
    if preferred is not None:
        return preferred
    votes = bags.groupBy("default_class").agg(F.count("*").alias("n"))
    return votes.agg(F.min_by("default_class", F.struct(-F.col("n"), F.col("default_class"))).alias("c")).first()["c"]


def _majority(tallies: Sequence[Column], classes: Sequence[object]) -> Column:
    """The class with most votes, the first on ties; null without votes."""
    tally = F.array(*tallies)
    most = F.array_max(tally)
    return F.when(most > 0, class_at((F.array_position(tally, most) - 1).cast("int"), classes))


def _count_class(i: int) -> Column:
    return F.count(F.when(F.col("ci") == i, 1)).alias(f"_t{i}")


def ensemble_predict(
    tx: DataFrame,
    rules: DataFrame,
    classes: Sequence[object],
    default_class: object,
    id_cols: Sequence[str] = ("rec_id",),
    model: Sequence[str] = (),
) -> DataFrame:
    """Majority of the bags' first matches. Bags without a match abstain; if all do, the default class."""
    index = scoring_index(rules, classes, model=model)
    k = range(len(classes))

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        per_bag = bag_matches(sets, index, keys, model).groupBy(*keys, "bag_id").agg(_first_class(len(classes)))
        tallies = per_bag.groupBy(*keys).agg(*[_count_class(i) for i in k])
        winner = _majority([F.col(f"_t{i}") for i in k], classes)
        return tallies.select(*keys, F.coalesce(winner, F.lit(default_class)).alias("prediction"))

    return per_item_set(tx, id_cols, model, score)


def ensemble_majority(
    tx: DataFrame,
    rules: DataFrame,
    bags: DataFrame,
    classes: Sequence[object],
    id_cols: Sequence[str] = ("rec_id",),
) -> DataFrame:
    """Majority of the bags' predictions in which a bag without a match votes for its default class.

    All bags start out voting for their defaults; each match moves its bag's vote from the default to the match.
    """
    k = range(len(classes))
    defaults = bags.select("bag_id", class_index(F.col("default_class"), classes).alias("di"))
    counted = {r["di"]: r["count"] for r in defaults.groupBy("di").count().collect()}
    index = scoring_index(rules, classes)
    moves = [(F.count(F.when(F.col("ci") == i, 1)) - F.count(F.when(F.col("di") == i, 1))).alias(f"_t{i}") for i in k]
    votes = [F.col(f"_t{i}") + F.lit(counted.get(i, 0)) for i in k]

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        per_bag = bag_matches(sets, index, keys).groupBy(*keys, "bag_id").agg(_first_class(len(classes)))
        tallies = per_bag.join(F.broadcast(defaults), "bag_id", "left").groupBy(*keys).agg(*moves)
        return tallies.select(*keys, _majority(votes, classes).alias("prediction"))

    return per_item_set(tx, id_cols, (), score)


def _bag_probabilities(tx, index, classes, settings, default_proba, id_cols) -> DataFrame:
    """Probabilities of every bag with a vote, and one row with bag_id null for a record none votes on."""
    votes = bag_matches(tx, index, id_cols).groupBy(*id_cols, "bag_id").agg(*_vote_aggregates(classes, [settings]))
    return _with_probability(votes, classes, settings, default_proba)


def ensemble_proba(
    tx: DataFrame,
    rules: DataFrame,
    num_bags: int,
    classes: Sequence[object],
    settings: VoteSettings | None = None,
    default_proba: Sequence[float] | None = None,
    id_cols: Sequence[str] = ("rec_id",),
) -> DataFrame:
    """Sum of the bags' probabilities, normalised. Bags without a vote add the default probabilities."""
    default = list(default_proba or uniform_proba(classes))
    index = scoring_index(rules, classes, (1,))
    k = range(len(classes))
    voted = F.col("bag_id").isNotNull()

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        per_bag = _bag_probabilities(sets, index, classes, settings or VoteSettings(), default, keys)
        sums = per_bag.groupBy(*keys).agg(
            F.count(F.when(voted, 1)).alias("_bags"),
            *[F.coalesce(F.sum(F.when(voted, F.get("probability", F.lit(i)))), F.lit(0.0)).alias(f"_p{i}") for i in k],
        )
        sums = sums.withColumns({f"_p{i}": F.col(f"_p{i}") + (num_bags - F.col("_bags")) * default[i] for i in k})
        total = sum((F.col(f"_p{i}") for i in k), F.lit(0.0))
        return sums.select(*keys, F.array(*[F.col(f"_p{i}") / total for i in k]).alias("probability"))

    return per_item_set(tx, id_cols, (), score)


def ensemble_weighted(
    tx: DataFrame,
    rules: DataFrame,
    num_bags: int,
    classes: Sequence[object],
    settings: VoteSettings | None = None,
    default_proba: Sequence[float] | None = None,
    id_cols: Sequence[str] = ("rec_id",),
) -> DataFrame:
    """Majority in which every bag votes for its most probable class, so none abstains."""
    default = list(default_proba or uniform_proba(classes))
    fallback = default.index(max(default))
    index = scoring_index(rules, classes, (1,))
    k = range(len(classes))
    votes = [
        F.col(f"_t{i}") + (F.lit(num_bags) - F.col("_bags") if i == fallback else F.lit(0)) for i in k
    ]

    def score(sets: DataFrame, keys: list[str]) -> DataFrame:
        per_bag = _bag_probabilities(sets, index, classes, settings or VoteSettings(), default, keys)
        ci = F.when(F.col("bag_id").isNotNull(), most_probable(F.col("probability")))
        tallies = per_bag.withColumn("ci", ci).groupBy(*keys).agg(F.count("bag_id").alias("_bags"), *[_count_class(i) for i in k])
        return tallies.select(*keys, _majority(votes, classes).alias("prediction"))

    return per_item_set(tx, id_cols, (), score)
