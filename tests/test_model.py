"""Coverage, merging, ensembles and the estimator on the small record sets."""

import random
from types import SimpleNamespace

import pytest
from pyspark.ml import PipelineModel
from golden import SIX, SIX_RULES
from pyspark.sql import functions as F

from ruleloom import RuleEstimator, RuleModel
from ruleloom.operators.coverage import cover, flatten_levels
from ruleloom.operators.items import label_counts, rank_items, select_positions
from ruleloom.operators.merge import merge_rules
from ruleloom.operators.prefix import merge_nodes, prefix_nodes, stored_paths
from ruleloom.operators.rules import model_stats, order_rules
from ruleloom.operators.scoring import (
    VoteSettings,
    ensemble_majority,
    ensemble_predict,
    ensemble_proba,
    ensemble_weighted,
    first_match,
    probabilities,
    vote_predict,
)
from ruleloom.operators.support import mine_support
from ruleloom.plans.estimator import LightModel
from ruleloom.staging import drop_staged, stage


@pytest.fixture(scope="module")
def six(transactions):
    return transactions(SIX)


@pytest.fixture(scope="module")
def six_rules(six):
    return stage(mine_support(six, 0.2, 0.5, 0.0), "six-rules")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(0, [20, 22]), (1, [20, 45, 22]), (2, [30]), (3, [])]
    return spark.createDataFrame(rows, "rec_id bigint, items array<bigint>")


def pick(*starts):
    return [line for s in starts for line in SIX_RULES if line.startswith(s + " (")]


def test_coverage_on_one_record(transactions, six_rules, lines):
    kept = cover(six_rules, transactions([((20, 21, 22), 1)]))
    assert lines(kept) == pick("22 21 -> 1", "22 21 -> 0", "22 -> 1", "22 -> 0")
    assert kept.where("level = 1").count() == 1


def test_coverage_on_own_records(six, six_rules, lines):
    kept = stage(cover(six_rules, six), "six-covered")
    want = pick("20 21 -> 0", "22 21 -> 1", "20 -> 0", "22 20 21 -> 0", "22 20 -> 0", "22 21 -> 0", "22 -> 1", "22 -> 0")
    assert lines(kept) == want
    assert lines(flatten_levels(kept)) == want
    assert kept.where("level = 1").count() == 2


def test_coverage_without_spare_rules(transactions, six_rules):
    kept = cover(six_rules, transactions([((20, 21, 22), 1)]), save_spare=False)
    assert kept.where("level = 2").isEmpty()


@pytest.mark.parametrize("voting", [True, False])
def test_known_superset_and_unseen_records(queries, six_rules, voting):
    if voting:
        rows = vote_predict(probabilities(queries, six_rules, [0, 1]), [0, 1]).collect()
    else:
        rows = first_match(queries, six_rules, [0, 1], 0).collect()
    assert {r["rec_id"]: r["prediction"] for r in rows} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_vote_settings():
    assert VoteSettings().shares_rest is False
    assert VoteSettings("max", "confidence").shares_rest is True
    for bad in ({"voting": "mode"}, {"metric": "lift"}, {"weight": "support"}):
        with pytest.raises(ValueError):
            VoteSettings(**bad)
        VoteSettings(**bad, compat=True)


def test_unknown_settings_fall_back(queries, six_rules):
    def run(settings):
        rows = probabilities(queries, six_rules, [0, 1], settings).orderBy("rec_id").collect()
        return [p for r in rows for p in r["probability"]]

    odd = VoteSettings("mode", "lift", "odd", compat=True)
    assert not odd.shares_rest
    # Every class has a vote for record 0 and 1, so the shared rest does not matter there.
    assert run(odd)[:4] == pytest.approx(run(VoteSettings("max", "confidence"))[:4])


def test_merging_a_model_with_itself_keeps_its_rules(six_rules):
    twice = six_rules.unionByName(six_rules.withColumn("bag_id", F.lit(1)))
    assert merge_rules(twice).count() == six_rules.count()


def test_merge_methods(spark):
    rows = [
        (0, 1, 1, [1, 2], 0, 0.5, 0.8, 1.0),
        (1, 1, 1, [2, 1], 0, 0.25, 0.6, 3.0),
        (1, 1, 2, [2], 0, 0.5, 1.0, float("nan")),
    ]
    table = spark.createDataFrame(
        rows,
        "bag_id int, level int, rank int, antecedent array<bigint>, consequent bigint, support double,"
        " confidence double, chi2 double",
    )
    want = {"max": (0.5, 0.8), "min": (0.25, 0.6), "product": (1 - 0.5 * 0.75, 1 - 0.2 * 0.4)}
    for method, (sup, conf) in want.items():
        merged = {tuple(r["antecedent"]): r for r in merge_rules(table, method).collect()}
        assert set(merged) == {(1, 2), (2,)}
        assert merged[1, 2]["support"] == pytest.approx(sup)
        assert merged[1, 2]["confidence"] == pytest.approx(conf)
        assert merged[1, 2]["chi2"] == 3.0
    with pytest.raises(ValueError):
        merge_rules(table, "mean")


def test_suffix_predicate_holds_for_the_rarest_item_only(six, lines):
    found = lines(mine_support(six, 0.2, 0.5, 0.0, suffix_predicate=F.col("item") != 20))
    assert found == [line for line in SIX_RULES if not line.startswith("20 ")]
    grown = lines(mine_support(six, 0.2, 0.5, 0.0, suffix_predicate=F.col("item") != 20, narrow=0))
    assert grown == found


@pytest.mark.parametrize("n", [1, 2])
def test_repeated_items_are_an_error(transactions, n):
    with pytest.raises(Exception, match="unique"):
        label_counts(transactions([((1, 1), 0)] * n)).collect()


def test_longer_rules_first_on_ties(six_rules):
    rows = order_rules(six_rules.drop("rank")).orderBy("rank").collect()
    keys = [(r["confidence"], r["support"], len(r["antecedent"])) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_select_positions(transactions):
    tx = transactions([((1, 5, 7), 0), ((1, 6, 8), 0), ((2, 5), 1), ((2, 6), 1)])
    counts = stage(label_counts(tx), "counts")
    rows = select_positions(tx, counts, 1).orderBy("rec_id").collect()
    # The third position occurs in class 0 only, so it alone has gain.
    assert [r["items"] for r in rows] == [[7], [8], [], []]


def test_prefix_tree_merge(spark):
    def tree(paths):
        rows = [(0, list(p), label, 1) for p, label in paths]
        return prefix_nodes(spark.createDataFrame(rows, "bag_id int, ranks array<string>, label bigint, n bigint"))

    first = tree([("abc", 1), ("aby", 0), ("b", 1)])
    second = tree([("ab", 1), ("abc", 1), ("abcd", 1), ("ax", 1), ("axy", 1), ("cn", 1), ("cm", 1)])

    def totals(nodes):
        rows = nodes.groupBy("prefix").agg(F.sum("n").alias("n")).collect()
        return {"".join(r["prefix"]): r["n"] for r in rows}

    assert totals(first) == {"a": 2, "b": 1, "ab": 2, "abc": 1, "aby": 1}
    merged = merge_nodes(first, second)
    assert totals(merged) == {
        "a": 7, "b": 1, "c": 2, "ab": 5, "ax": 2, "abc": 3, "aby": 1, "abcd": 1, "axy": 1, "cn": 1, "cm": 1,
    }
    paths = {"".join(r["ranks"]) + str(r["label"]): r["n"] for r in stored_paths(merged).collect()}
    assert paths == {
        "abc1": 2, "aby0": 1, "b1": 1, "ab1": 1, "abcd1": 1, "ax1": 1, "axy1": 1, "cn1": 1, "cm1": 1,
    }


def test_gain_ranking_needs_positive_gain(transactions):
    counts = stage(label_counts(transactions([((1, 2), 0), ((1, 3), 1), ((1, 2), 0), ((1, 3), 1)])), "counts")
    assert sorted(r["item"] for r in rank_items(counts, 0.1, "gain").collect()) == [2, 3]


@pytest.fixture(scope="module")
def bagged_model(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(2, 12), 13, 14], rng.randint(0, 1)) for i in range(500)]
    data = spark.createDataFrame(rows, "rec_id bigint, items array<bigint>, label bigint")
    model = RuleEstimator(numModels=2, sampleSize=0.5, minSupport=0.05, minChi2=0.0, seed=1).fit(data)
    return model, data


def test_estimator_end_to_end(bagged_model, tmp_path, spark):
    model, data = bagged_model
    assert model.text().count() >= 4
    predicted = model.transform(data)
    assert predicted.count() == 500
    assert {r["prediction"] for r in predicted.select("prediction").distinct().collect()} <= {0, 1}

    # One set of items is scored and joined back once: no second distinct or join around the prediction.
    plan = predicted._jdf.queryExecution().optimizedPlan().toString()
    direct = model.predict(data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == direct.count("Join") and plan.count("Aggregate") == direct.count("Aggregate")
    clash = data.selectExpr("rec_id AS items", "items AS sets", "label AS set_of_items")
    other = model.copy()._set(itemsCol="sets")
    assert sorted(tuple(r) for r in other.transform(clash).select("items", "prediction").collect()) == sorted(
        tuple(r) for r in predicted.select("rec_id", "prediction").collect()
    )

    path = str(tmp_path / "model")
    model.save(path)
    again = RuleModel.load(spark, path)
    assert again.value("numModels") == 2 and again.class_list == [0, 1]
    assert again.transform(data).exceptAll(predicted).isEmpty()
    model.write_text(str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).where("value like 'Model %'").count() == 2


def test_light_model_and_common_coverage(bagged_model):
    model, data = bagged_model
    light = model.light("max")
    proba = light.predict_proba(data, VoteSettings("max", "confidence")).collect()
    assert len(proba) == 500 and all(abs(sum(r["probability"]) - 1) < 1e-10 for r in proba)
    assert light.predict(data, with_voting=False).count() == 500
    assert model.covered_on(data).rules.where("level = 1").count() <= model.rules.where("level = 1").count()
    stats = model.stats().first()
    assert stats["rules_1"] == model.rules.where("level = 1").count()


def test_models_are_pipeline_stages(bagged_model, tmp_path, spark):
    model, data = bagged_model
    path = str(tmp_path / "pipeline")
    PipelineModel([model]).write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].uid == model.uid
    assert again.transform(data).exceptAll(model.transform(data)).isEmpty()

    light = model.light("max")
    light.save(str(tmp_path / "light"))
    loaded = LightModel.load(spark, str(tmp_path / "light"))
    assert loaded.predict(data).exceptAll(light.predict(data)).isEmpty()
    assert loaded.text().count() == light.stats().first()["rules_1"] + light.stats().first()["rules_2"]


def test_staged_tables_are_dropped_on_demand():
    calls = []
    system = SimpleNamespace(delete=lambda path, deep: calls.append((path, deep)))

    class Path(str):
        def getFileSystem(self, conf):
            return system

    hadoop = SimpleNamespace(fs=SimpleNamespace(Path=Path))
    stub = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: "hdfs:/shared"),
        sparkContext=SimpleNamespace(applicationId="app1", getCheckpointDir=lambda: None, master="yarn"),
        _jvm=SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=hadoop))),
        _jsc=SimpleNamespace(hadoopConfiguration=lambda: None),
    )
    drop_staged(stub)
    assert calls == [("hdfs:/shared/ruleloom/app1", True)]


def test_ensemble_answers_agree_with_their_definition(spark, bagged_model):
    """Bag by bag with the single-model operators, then combined in Python."""
    model, data = bagged_model
    seen = data.limit(40).select("rec_id", "items")
    unseen = spark.createDataFrame([(900, [77]), (901, [])], "rec_id bigint, items array<bigint>")
    tx = stage(seen.unionByName(unseen), "ensemble-data")
    bags = {r["bag_id"]: r["default_class"] for r in model.bags.collect()}
    vote = VoteSettings("max", "confidence")
    firsts, probas = {}, {}
    for b in bags:
        own = model.rules.where(F.col("bag_id") == b)
        firsts[b] = {r["rec_id"]: r["prediction"] for r in first_match(tx, own, [0, 1]).collect()}
        rows = probabilities(tx, own, [0, 1], vote).collect()
        probas[b] = {r["rec_id"]: r["probability"] for r in rows}

    def most(votes):
        return min(set(votes), key=lambda v: (-votes.count(v), v))

    def got(df, column="prediction"):
        return {r["rec_id"]: r[column] for r in df.collect()}

    ids = [r["rec_id"] for r in tx.collect()]
    abstain = got(ensemble_predict(tx, model.rules, [0, 1], 1))
    majority = got(ensemble_majority(tx, model.rules, model.bags, [0, 1]))
    weighted = got(ensemble_weighted(tx, model.rules, len(bags), [0, 1], vote))
    summed = got(ensemble_proba(tx, model.rules, len(bags), [0, 1], vote), "probability")
    for i in ids:
        votes = [firsts[b][i] for b in bags if firsts[b][i] is not None]
        assert abstain[i] == (most(votes) if votes else 1)
        assert majority[i] == most([bags[b] if firsts[b][i] is None else firsts[b][i] for b in bags])
        assert weighted[i] == most([probas[b][i].index(max(probas[b][i])) for b in bags])
        sums = [sum(probas[b][i][c] for b in bags) for c in (0, 1)]
        assert summed[i] == pytest.approx([s / sum(sums) for s in sums])


def test_stats_count_bags_without_rules(spark, six_rules):
    bags = spark.createDataFrame([(0,), (1,)], "bag_id int")
    stats = model_stats(six_rules, bags).first()
    assert stats["rules_1"] == 9 and stats["rules_2"] == 0
    assert stats["length_1"] == pytest.approx(stats["items_1"] / 9 / 2)
