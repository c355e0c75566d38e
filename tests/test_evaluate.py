import random
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ruleloom.operators import evaluate, scoring
from ruleloom.operators.indexing import depth_ranges, group_index
from ruleloom.operators.sampling import kfold
from ruleloom.operators.scoring import VoteSettings
from ruleloom.plans.crossval import (
    binary_grid,
    cross_validate,
    fold_measures,
    grid_scores,
    light_fold_rules,
    score_folds,
    train_folds,
)
from ruleloom.plans.training import TrainingSettings, train_ensemble
from ruleloom.staging import stage, stage_root


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), i % 3, rng.choice([0.1, 0.25, 0.5, 0.6, 0.9, rng.random()])) for i in range(600)]
    return spark.createDataFrame(rows, "rec_id bigint, label int, fold int, score double")


def test_area_agrees_with_the_builtin_evaluator(scored):
    areas = {r["fold"]: r["auc"] for r in evaluate.auc(scored).collect()}
    builtin = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    for fold, area in areas.items():
        assert area == pytest.approx(builtin.evaluate(scored.where(f"fold = {fold}")), abs=1e-12)
    assert evaluate.auc(scored, ()).first()["auc"] == pytest.approx(builtin.evaluate(scored), abs=1e-12)


def test_curves_of_a_single_class(spark):
    rows = [(0, 0, 0.3), (0, 0, 0.8), (1, 1, 0.3), (1, 1, 0.8)]
    one_sided = spark.createDataFrame(rows, "fold int, label int, score double")
    assert {r["fold"]: r["auc"] for r in evaluate.auc(one_sided).collect()} == {0: 0.0, 1: 1.0}
    points = evaluate.roc(one_sided).where("part = 1").collect()
    assert all((r["tpr"] if r["fold"] == 0 else r["fpr"]) == 0.0 for r in points)


def test_roc_runs_from_corner_to_corner(scored):
    rows = evaluate.roc(scored).where("fold = 0").orderBy("part", "fpr", "tpr").collect()
    assert (rows[0]["fpr"], rows[0]["tpr"]) == (0.0, 0.0) and (rows[-1]["fpr"], rows[-1]["tpr"]) == (1.0, 1.0)
    assert [r["tpr"] for r in rows] == sorted(r["tpr"] for r in rows)


def test_accuracy_curve_and_best_threshold(scored):
    rows = scored.collect()
    curve = {(r["fold"], r["threshold"]): r["accuracy"] for r in evaluate.accuracy_curve(scored).collect()}
    means = {}
    for t in evaluate.THRESHOLDS:
        per_fold = []
        for fold in range(3):
            own = [r for r in rows if r["fold"] == fold]
            per_fold.append(sum((r["score"] >= t) == (r["label"] == 1) for r in own) / len(own))
            assert curve[fold, t] == pytest.approx(per_fold[-1])
        means[t] = sum(per_fold) / 3
    best = evaluate.best_threshold(evaluate.accuracy_curve(scored)).first()
    assert best["threshold"] == min(means, key=lambda t: (-round(means[t], 12), t))
    at = evaluate.accuracy(evaluate.threshold_predict(scored), ["fold"]).collect()
    assert {r["fold"]: r["accuracy"] for r in at} == pytest.approx({f: curve[f, 0.6] for f in range(3)})


def test_confusions_add_up(spark):
    rows = [(0, 1, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    predictions = spark.createDataFrame(rows, "fold int, label int, prediction int")
    cells = evaluate.cv_confusion(evaluate.confusion(predictions, ["fold"])).collect()
    assert {(r["label"], r["prediction"]): r["share"] for r in cells} == {(1, 1): 0.5, (1, 0): 0.25, (0, 0): 0.25}


def separable(spark, n=240):
    rows = [(i, [f"a={i % 4}", f"b={i % 3}"], i % 4 // 2) for i in range(n)]
    return spark.createDataFrame(rows, "rec_id bigint, items array<string>, label bigint")


def test_cross_validation_learns_a_rule(spark):
    tx = separable(spark)
    settings = TrainingSettings(num_models=2, sample_size=0.6, min_support=0.05, seed=2)
    predictions = cross_validate(tx, settings, [0, 1], k=3)
    assert predictions.count() == 240
    assert evaluate.accuracy(predictions).first()["accuracy"] == 1.0


def test_folds_in_one_plan_equal_folds_trained_apart(spark):
    tx = separable(spark)
    settings = TrainingSettings(num_models=2, sample_size=0.4, min_support=0.1, min_chi2=0.0, seed=4)
    together, _ = train_folds(tx, settings, 3)
    apart, _ = train_ensemble(kfold(tx, 3).where("fold <> 1").drop("fold"), settings)
    columns = ["bag_id", "level", "rank", "antecedent", "consequent", "support", "confidence"]
    mine, theirs = together.where("fold = 1").select(columns), apart.select(columns)
    assert mine.count() > 0
    assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
    assert fold_measures(cross_validate(tx, settings, [0, 1], 3), together).count() == 3


def test_binary_grid_has_every_point(spark):
    settings = TrainingSettings(
        num_models=2, sample_size=0.4, min_support=0.05, strategy="gain", with_coverage=False, with_replacement=False
    )
    grid = binary_grid(separable(spark), settings, {"none": None, "over": {0: 1.0, 1: 1.5}}, k=2).collect()
    assert len(grid) == 2 * 2 * 8
    assert all(r["mean"] == pytest.approx(1.0) for r in grid if r["measure"] == "auc")


def test_grid_points_share_one_match(spark, monkeypatch):
    """Every point has the scores it has alone; the rules are matched once for all of them."""
    tx = separable(spark)
    settings = TrainingSettings(num_models=2, sample_size=0.4, min_support=0.05, strategy="gain", with_coverage=False, with_replacement=False)
    light = stage(light_fold_rules(train_folds(tx, settings, 2)[0]), "test-light")
    points = [VoteSettings(v, m, w) for v in ("max", "min", "mean") for m in ("confidence", "support") for w in ("none", "numRules")]
    calls = []
    monkeypatch.setattr(scoring, "match", lambda *a, own=scoring.match, **b: calls.append(1) or own(*a, **b))
    together = stage(grid_scores(tx, light, points, [0.4, 0.6], 2), "test-grid")
    assert len(calls) == 1
    for k in (0, 3, 6, 11):
        alone = {r["rec_id"]: r["score"] for r in score_folds(tx, light, points[k], [0.4, 0.6], 2).collect()}
        assert alone == {r["rec_id"]: r["score"] for r in together.where(f"point = {k}").collect()}


def session_stub(configured=None, context=None, master="yarn"):
    conf = SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else default)
    spark_context = SimpleNamespace(getCheckpointDir=lambda: context, master=master, applicationId="stub")
    return SimpleNamespace(conf=conf, sparkContext=spark_context)


def test_staging_folder_comes_from_the_session():
    assert stage_root(session_stub("hdfs:/shared/", "hdfs:/other")) == "hdfs:/shared"
    assert stage_root(session_stub(None, "hdfs:/other/x")) == "hdfs:/other/x"
    assert stage_root(session_stub(master="local[2]")).startswith(tempfile.gettempdir())
    with pytest.raises(RuntimeError):
        stage_root(session_stub())


def test_crowded_scores_fall_into_ranges_of_equal_depth(spark):
    """99 % of the scores lie in one thousandth of the span; no range is deeper than twice the mean, the curve is exact."""
    rng = random.Random(8)
    rows = [(0, rng.randint(0, 1), 0.5 + rng.random() / 1000 if i % 100 else rng.random()) for i in range(8000)] + [(1, 1, 0.2), (1, 0, None)]
    crowded = spark.createDataFrame(rows, "fold int, label int, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = [r["count"] for r in depth_ranges(crowded, [F.asc("fold"), F.desc("score")], "part").groupBy("part").count().collect()]
        points = [tuple(r) for r in evaluate.roc(crowded).where("fold = 0 and part = 1").select("score", "fpr", "tpr").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(ranges) <= 2 * sum(ranges) / len(ranges)
    labels = [(s, y) for fold, y, s in rows if fold == 0]
    wanted, above = {}, [0, 0]
    totals = [sum(y == v for _, y in labels) for v in (0, 1)]
    for s, y in sorted(labels, reverse=True):
        above[y] += 1
        wanted[s] = (above[0] / totals[0], above[1] / totals[1])
    assert {s: x for s, x, _ in points} == pytest.approx({s: x for s, (x, _) in wanted.items()})
    assert {s: y for s, _, y in points} == pytest.approx({s: y for s, (_, y) in wanted.items()})


def test_ranks_of_a_large_group(spark):
    rows = [(0 if i % 9 else 1, i * 7919 % 1000) for i in range(1000)]
    ranked = group_index(spark.createDataFrame(rows, "bag_id int, v int"), ["bag_id"], [F.desc("v")], "place").collect()
    for bag in (0, 1):
        own = sorted((v for b, v in rows if b == bag), reverse=True)
        assert [r["v"] for r in sorted((r for r in ranked if r["bag_id"] == bag), key=lambda r: r["place"])] == own
        assert sorted(r["place"] for r in ranked if r["bag_id"] == bag) == list(range(len(own)))
    assert group_index(spark.createDataFrame([], "bag_id int, v int"), ["bag_id"], [F.desc("v")], "place").count() == 0


def test_item_sets_of_most_rows_are_joined_back_apart(spark, monkeypatch):
    """One item set on nine tenths of the rows, null and empty sets, repeated and null ids: the same rows as by one join."""
    rows = [(i if i % 50 else None, ["a=1", "b=1"] if i % 10 else [f"a={i % 3}", f"c={i}"], "x" if i % 10 else "y") for i in range(1200)]
    tx = spark.createDataFrame(rows + [(7, None, "x"), (8, [], "y")], "rec_id bigint, items array<string>, label string")
    settings = TrainingSettings(num_models=2, sample_size=0.5, min_support=0.05, min_chi2=0.0)
    rules, bags = train_ensemble(tx.where("items is not null"), settings)

    def results():
        first = scoring.ensemble_predict(tx, rules, ["x", "y"], "y")
        proba = scoring.ensemble_proba(tx, rules, 2, ["x", "y"])
        return [sorted(map(repr, d.collect())) for d in (first, proba)]

    plain = results()
    monkeypatch.setattr(scoring, "HOT_ROWS", 10)
    assert results() == plain and len(plain[0]) == 1202
    hot = scoring.ensemble_predict(tx, rules, ["x", "y"], "y")
    assert "Union" in hot._jdf.queryExecution().toString()
