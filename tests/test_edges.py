"""Rows with null or equal ids, null items, unknown values, and counts beyond the small ranges."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.metrics import gain_exceeds
from ruleloom.operators import coverage, items, sampling, scoring
from ruleloom.operators.gain import mine_gain
from ruleloom.operators.support import mine_support
from ruleloom.plans import catalog
from ruleloom.plans.estimator import RuleEstimator
from ruleloom.plans.training import TrainingSettings, train_bags
from ruleloom.sources import text


@pytest.mark.parametrize("entries", [2, 6000])
def test_encode_has_one_behaviour_at_all_sizes(spark, entries):
    values = [(0, f"v{k}", k) for k in range(entries)] + [(1, "p", entries)]
    dictionary = spark.createDataFrame(values, "pos int, value string, item_id long")
    rows = [(1, ["v1", "p"]), (1, ["v0", "p"]), (1, ["v0", "p"]), (None, ["v1", "p"]), (2, [])]
    records = spark.createDataFrame(rows, "rec_id long, fields array<string>")
    got = sorted(((r["rec_id"], r["ids"]) for r in text.encode(records, dictionary).collect()), key=str)
    assert got == sorted([(1, [1, entries]), (1, [0, entries]), (1, [0, entries]), (None, [1, entries]), (2, [])], key=str)
    odd = spark.createDataFrame([(1, ["zz", "p"]), (2, ["q", "r"])], "rec_id long, fields array<string>")
    with pytest.raises(Exception, match="not in the dictionary"):
        text.encode(odd, dictionary).collect()
    dropped = {r["rec_id"]: r["ids"] for r in text.encode(odd, dictionary, unknown="drop").collect()}
    assert dropped == {1: [entries], 2: []}


def test_zero_gain_is_zero_at_any_size(spark):
    rng = random.Random(2)
    rows = []
    for parent in (3_000_000_000, 5_000_000_000, 8_000_000_000_000):
        for _ in range(120):
            scale = rng.randint(2, 1000)
            a, b = rng.randint(1, parent // scale // 2), rng.randint(1, parent // scale // 2)
            rows.append(((a, b), (a * scale, b * scale)))
            rows.append(((a + 1, b), (a * scale, b * scale)))
    counts = [(sum(c), sum(x * x for x in c), sum(p), sum(x * x for x in p)) for c, p in rows]
    frame = spark.createDataFrame([(n, str(s), m, str(t)) for n, s, m, t in counts], "n long, s string, m long, t string")
    more = gain_exceeds(F.col("n"), F.col("s").cast("decimal(38,0)"), F.col("m"), F.col("t").cast("decimal(38,0)"), 0.0)
    got = [r["more"] for r in frame.select(more.alias("more")).collect()]
    want = [Fraction(s, n * n) > Fraction(t, m * m) for n, s, m, t in counts]
    assert got == want and not all(want) and any(want)


def test_many_classes(spark):
    classes = list(range(70_000))
    rules = [(0, 1, rank, [f"i{c}"], c, 0.1, 0.9) for rank, c in enumerate([69_999, 65_536, 3, 65_535], 1)]
    table = spark.createDataFrame(rules, "bag_id int, level int, rank int, antecedent array<string>, consequent int, support double, confidence double")
    tx = spark.createDataFrame([(c, [f"i{c}", "x"]) for c in (69_999, 65_536, 3, 65_535, 7)], "rec_id long, items array<string>")
    got = {r["rec_id"]: r["prediction"] for r in scoring.first_match(tx, table, classes, -1).collect()}
    assert got == {69_999: 69_999, 65_536: 65_536, 3: 3, 65_535: 65_535, 7: -1}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["c", "d"], i % 2) for i in range(60)]
    data = spark.createDataFrame(rows, "rec_id long, items array<string>, label int")
    return RuleEstimator(numModels=2, sampleSize=0.5, minSupport=0.1, minChi2=0.0, seed=3).fit(data)


@pytest.mark.parametrize("weighted", [False, True])
def test_transform_keeps_every_row(spark, model, weighted):
    rows = [(1, ["a", "b"], "x"), (1, ["c"], "y"), (None, ["a"], "z"), (5, ["c", "d"], "x"), (5, ["c", "d"], "x"), (6, None, "n"), (7, [], "n")]
    data = spark.createDataFrame(rows, "rec_id long, items array<string>, prediction_note string")
    model._set(withWeight=weighted)
    out = model.transform(data)
    assert out.columns == [*data.columns, "prediction"]
    got = out.collect()
    assert sorted(tuple(r)[:3] for r in got if r["rec_id"] is not None and r["items"]) == sorted(r for r in rows if r[0] is not None and r[1])
    assert len(got) == len(rows)
    if not weighted:
        assert all(r["prediction"] == (1 if "a" in r["items"] else 0) for r in got if r["items"])
    assert all(r["prediction"] is not None for r in got)


def test_null_items_count_as_no_items(spark):
    rows = [(0, 0, ["a", None, "b"]), (1, 0, ["a"]), (2, 1, None), (3, 1, ["b"]), (4, 0, [None])]
    tx = spark.createDataFrame(rows, "rec_id long, label int, items array<string>").withColumn("bag_id", F.lit(0))
    counts = items.label_counts(tx)
    assert {r["label"]: r["n_class"] for r in items.class_counts(counts).collect()} == {0: 3, 1: 2}
    assert {(r["item"], r["label"]): r["n"] for r in items.item_counts(counts).collect()} == {("a", 0): 2, ("b", 0): 1, ("b", 1): 1}
    clean = tx.withColumn("items", F.coalesce(F.array_compact("items"), F.array().cast("array<string>")))
    for mine in (mine_support, mine_gain):
        for limit in (0, 100):
            found, want = (sorted(map(str, mine(t, 0.1, 0.1, 0.0, map_limit=limit).collect())) for t in (tx, clean))
            assert found == want and (found or mine is mine_gain)


def test_null_ids_stay(spark):
    tx = spark.createDataFrame([(None, 1), (None, 1), (1, 0), (2, 1)], "rec_id long, label int")
    train, test = sampling.train_test_split(tx, 0.5)
    assert train.count() + test.count() == 4
    folds = sampling.kfold(tx, 3).collect()
    assert len(folds) == 4 and all(r["fold"] is not None for r in folds)
    assert sampling.bag_sample(tx, 2, 0.5, with_replacement=False).count() == 4
    assert all(r["bag_id"] is not None for r in sampling.bag_sample(tx, 3, 1.0).collect())


def test_coverage_without_broadcast(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.sample("abcdefgh", rng.randint(1, 5)), rng.randint(0, 1), i % 2) for i in range(400)]
    tx = spark.createDataFrame(rows, "rec_id long, items array<string>, label int, bag_id int")
    rules, _ = train_bags(tx, TrainingSettings(num_models=2, min_support=0.02, min_confidence=0.5, min_chi2=0.0, with_coverage=False))

    def covered():
        return sorted((r["bag_id"], r["level"], r["rank"]) for r in coverage.cover(rules, tx).collect())

    by_broadcast = covered()
    monkeypatch.setattr(coverage, "STATE_LIMIT", 0)
    assert covered() == by_broadcast
    assert {level for _, level, _ in by_broadcast} >= {1}


def test_ranks_are_looked_up_once(spark, transactions):
    """Dropping records without a ranked item does not look the ranks up a second time."""
    tx = transactions([(["a", "b"], 0), (["c"], 1), ([], 1), (["b", "a"], 0), (["a"], 1)])
    ranks = spark.createDataFrame([(0, "a", 1), (0, "b", 0)], "bag_id int, item string, rank int")
    encoded = items.rank_encode(tx, ranks)
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("_rank_of#") <= 4
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("transform(items") == 1
    assert sorted((r["rec_id"], r["ranks"]) for r in encoded.collect()) == [(0, [0, 1]), (3, [0, 1]), (4, [1])]


def test_baskets_are_joined_once(spark, tmp_path):
    """Both queries on order baskets read one staged table, in which equal baskets are counted together."""
    spark.createDataFrame([(1, "B1"), (2, "B2")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, "F") for i in range(6)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    bought = [(i, 1 + k) for i in range(6) for k in range(1 + i % 2)]
    spark.createDataFrame(bought, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    table = catalog.basket_input(spark, str(tmp_path))
    assert catalog.basket_input(spark, str(tmp_path)) is table
    assert sorted((r["items"], r["label"], r["n"]) for r in table.collect()) == [(["B1"], "F", 3), (["B1", "B2"], "F", 3)]
    assert catalog.QUERIES["rules_support_baskets"](spark, str(tmp_path)).count() > 0
