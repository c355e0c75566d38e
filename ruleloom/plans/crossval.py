"""Cross-validation with all folds in one plan.

The sample is drawn once per record, then every sampled record goes to the bags of each fold it is trained in. A draw
depends on the record id and the seed only, so this gives each fold the very bags it would draw by itself. Rules,
default classes and predictions carry the fold; no fold is a driver loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.evaluate import accuracy, accuracy_curve, auc, best_threshold, describe, roc, threshold_predict
from ruleloom.operators.items import compact
from ruleloom.operators.merge import merge_rules
from ruleloom.operators.sampling import kfold, stratified_resample, training_folds
from ruleloom.operators.scoring import VoteSettings, ensemble_predict, grid_probabilities, probabilities
from ruleloom.plans.training import TrainingSettings, draw_bags, train_bags
from ruleloom.staging import stage


def train_folds(
    tx: DataFrame,
    settings: TrainingSettings,
    k: int = 10,
    seed: int = 12345,
    fractions: Mapping[object, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rules, bags) of all folds, both with `fold` and `bag_id`. `fractions` resamples the training classes."""
    settings.check()
    folded = kfold(tx, k, seed)
    if fractions is not None:
        folded = stratified_resample(folded, fractions, settings.seed)
        folded = folded.withColumn("rec_id", F.concat_ws("/", F.col("rec_id").cast("string"), "copy")).drop("copy")
    models = settings.num_models
    fold, bag = F.floor(F.col("bag_id") / models).cast("int"), (F.col("bag_id") % models).cast("int")
    together = F.col("fold") * models + F.col("bag")
    # Equal records of the same fold and bag are counted first, so that the copies for the folds are few.
    drawn = draw_bags(folded, settings).withColumn("bag_id", F.col("fold") * models + F.col("bag_id"))
    counted = compact(drawn).withColumn("fold", fold).withColumn("bag", bag)
    bagged = training_folds(counted, k).withColumn("bag_id", together).drop("fold", "bag")
    rules, bags = train_bags(bagged, settings)
    return tuple(t.withColumn("fold", fold).withColumn("bag_id", bag) for t in (rules, bags))


def predict_folds(
    tx: DataFrame, rules: DataFrame, bags: DataFrame, classes: Sequence[object], k: int = 10, seed: int = 12345
) -> DataFrame:
    """(rec_id, label, fold, prediction): every record judged by the ensemble of the fold it was held out from."""
    held_out = kfold(tx, k, seed)
    votes = bags.groupBy("fold", "default_class").agg(F.count("*").alias("n"))
    defaults = votes.groupBy("fold").agg(
        F.min_by("default_class", F.struct(-F.col("n"), F.col("default_class"))).alias("default_class")
    )
    predicted = ensemble_predict(held_out, rules, classes, None, ("rec_id", "label", "fold"), ("fold",))
    return (
        predicted.join(F.broadcast(defaults), "fold", "left")
        .withColumn("prediction", F.coalesce("prediction", "default_class"))
        .select("rec_id", "label", "fold", "prediction")
    )


def cross_validate(
    tx: DataFrame, settings: TrainingSettings, classes: Sequence[object], k: int = 10, seed: int = 12345
) -> DataFrame:
    rules, bags = train_folds(tx, settings, k, seed)
    return predict_folds(tx, rules, bags, classes, k, seed)


def fold_measures(predictions: DataFrame, rules: DataFrame) -> DataFrame:
    """Per fold: accuracy, rules of both levels, antecedent items."""
    sizes = rules.groupBy("fold").agg(
        F.count(F.when(F.col("level") == 1, 1)).alias("rules_1"),
        F.count(F.when(F.col("level") == 2, 1)).alias("rules_2"),
        F.sum(F.size("antecedent")).alias("items"),
    )
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rules_1", "rules_2", "items")]
    return accuracy(predictions, ["fold"]).join(sizes, "fold", "left").select("fold", "accuracy", *counted)


def cv_summary(measures: DataFrame) -> DataFrame:
    return describe(measures, [c for c in measures.columns if c != "fold"])


def score_folds(
    tx: DataFrame,
    light_rules: DataFrame,
    settings: VoteSettings,
    default_proba: Sequence[float],
    k: int = 10,
    seed: int = 12345,
) -> DataFrame:
    """(rec_id, label, fold, score) of a binary task; score is the probability of class 1 by the fold's merged model."""
    held_out = kfold(tx, k, seed)
    scored = probabilities(
        held_out, light_rules, [0, 1], settings, default_proba, ("rec_id", "label", "fold"), ("fold",)
    )
    return scored.select("rec_id", "label", "fold", F.get("probability", F.lit(1)).alias("score"))


def light_fold_rules(rules: DataFrame, method: str = "max") -> DataFrame:
    """Each fold's bags merged into one model."""
    return merge_rules(rules, method, ("fold",))


def grid_scores(
    tx: DataFrame,
    light_rules: DataFrame,
    settings: Sequence[VoteSettings],
    default_proba: Sequence[float],
    k: int = 10,
    seed: int = 12345,
) -> DataFrame:
    """(rec_id, label, fold, point, score): `score_folds` under all settings, numbered from 0, with one match of the rules."""
    held_out = kfold(tx, k, seed)
    keys = ("rec_id", "label", "fold")
    scored = grid_probabilities(held_out, light_rules, [0, 1], settings, default_proba, keys, ("fold",))
    each = scored.select(*keys, F.posexplode("probabilities").alias("point", "probability"))
    return each.select(*keys, "point", F.get("probability", F.lit(1)).alias("score"))


def binary_measures(scored: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Per fold: area under ROC and accuracy at the decision threshold."""
    return auc(scored, by).join(accuracy(threshold_predict(scored), by), [*by]).select(*by, "auc", "accuracy")


def class_shares(tx: DataFrame, classes: Sequence[object]) -> tuple[dict[object, int], list[float]]:
    """Class counts and their shares in class order; one row per class comes to the driver."""
    counts = {r["label"]: r["count"] for r in tx.groupBy("label").count().collect()}
    total = sum(counts.values())
    return counts, [counts.get(c, 0) / total for c in classes]


def model_measures(rules: DataFrame, light: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold of `folds`: rules of all bags, and rules and mean antecedent lengths of the merged model by level."""
    size = F.size("antecedent")
    complete = rules.groupBy("fold").agg(F.count("*").alias("rules"))
    merged = light.groupBy("fold").agg(
        *[F.count(F.when(F.col("level") == v, 1)).alias(f"light_rules_{v}") for v in (1, 2)],
        *[F.avg(F.when(F.col("level") == v, size)).alias(f"length_{v}") for v in (1, 2)],
    )
    joined = folds.join(complete, "fold", "left").join(merged, "fold", "left")
    return joined.select("fold", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in MODEL_MEASURES])


MODEL_MEASURES = ("rules", "light_rules_1", "light_rules_2", "length_1", "length_2")


def binary_reports(
    tx: DataFrame,
    settings: TrainingSettings,
    samplings: Mapping[str, Mapping[object, float] | None],
    votings: Sequence[str] = ("max", "min"),
    weights: Sequence[str] = ("none",),
    metric: str = "confidence",
    k: int = 10,
    seed: int = 12345,
    default_proba: Sequence[float] | None = None,
) -> dict[str, DataFrame]:
    """Grid sampling x voting x weight.

    Rules are mined and matched once per sampling; every point's votes come from that match, and all points of all samplings
    are measured together, keyed by sampling and point.

    grid: (sampling, voting, weight, measure, mean, stddev) for auc, accuracy, the accuracy at the best threshold, and the
    sizes of the models. roc: the points of every fold's curve at every grid point.
    """
    if default_proba is None:
        _, default_proba = class_shares(tx, [0, 1])
    points = [VoteSettings(voting, metric, weight) for voting in votings for weight in weights]
    names = {n: F.array(*[F.lit(getattr(p, n)) for p in points]) for n in ("voting", "weight")}
    models, scores = {}, []
    for sampling, fractions in samplings.items():
        rules, _ = train_folds(tx, settings, k, seed, fractions)
        light = stage(light_fold_rules(rules), "light-rules")
        models[sampling] = rules, light
        scores.append(grid_scores(tx, light, points, default_proba, k, seed).withColumn("sampling", F.lit(sampling)))
    scored = stage(reduce(DataFrame.unionByName, scores), "fold-scores")
    by = ["sampling", "point"]
    best = best_threshold(accuracy_curve(scored, [*by, "fold"]), by)
    best = best.withColumn("measure", F.concat(F.lit("accuracy at "), F.format_string("%.1f", "threshold")))
    folds = scored.select("fold").distinct()
    sizes = [model_measures(*found, folds).withColumn("sampling", F.lit(s)) for s, found in models.items()]
    sizes = describe(reduce(DataFrame.unionByName, sizes), MODEL_MEASURES, ["sampling"])
    sizes = sizes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))))
    found = [describe(binary_measures(scored, [*by, "fold"]), ["auc", "accuracy"], by), sizes, best]
    grid = reduce(DataFrame.unionByName, [f.select(*by, "measure", "mean", "stddev") for f in found])
    curves = roc(scored, [*by, "fold"])

    def named(table: DataFrame) -> DataFrame:
        point = [F.get(column, F.col("point")).alias(n) for n, column in names.items()]
        return table.select("sampling", *point, *[c for c in table.columns if c not in by])

    return {"grid": named(grid), "roc": named(curves)}


def binary_grid(*arguments, **settings) -> DataFrame:
    """The grid of `binary_reports` alone."""
    return binary_reports(*arguments, **settings)["grid"]
