import math

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.hashing import poisson_steps
from ruleloom.operators import sampling


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20000).select(
        F.col("id").alias("rec_id"), F.array(F.col("id") % 7).alias("items"), (F.col("id") % 2).alias("label")
    )


def test_poisson_steps_are_the_distribution():
    steps = poisson_steps(2.5)
    want = [sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1)) for k in range(len(steps))]
    assert steps == pytest.approx(want)
    assert poisson_steps(0.0) == []
    assert 1 - steps[-1] < 1e-8


def test_bags_have_their_share_and_do_not_depend_on_partitioning(ids):
    bags = sampling.bag_sample(ids, 4, 0.5, True, 3)
    sizes = {r["bag_id"]: r["count"] for r in bags.groupBy("bag_id").count().collect()}
    assert set(sizes) == {0, 1, 2, 3}
    assert all(abs(n - 10000) < 500 for n in sizes.values())
    again = sampling.bag_sample(ids.repartition(5), 4, 0.5, True, 3)
    assert bags.exceptAll(again).isEmpty() and again.exceptAll(bags).isEmpty()


def test_sampling_without_replacement_takes_each_record_once(ids):
    bags = sampling.bag_sample(ids, 4, 0.1, False, 3)
    assert bags.count() == bags.select("rec_id").distinct().count()
    with pytest.raises(ValueError):
        sampling.bag_sample(ids, 20, 0.1, False)


def test_contiguous_bags_are_ordered_and_even(ids):
    rows = sampling.bag_contiguous(ids, 5, 0.1, 1).orderBy("rec_id").collect()
    bags = [r["bag_id"] for r in rows]
    assert bags == sorted(bags)
    assert max(bags.count(b) for b in range(5)) - min(bags.count(b) for b in range(5)) <= 1


def test_partition_bags_join_neighbouring_partitions(spark):
    df = spark.range(0, 800, numPartitions=8).select(F.col("id").alias("rec_id"))
    rows = sampling.bag_by_partition(df, 4, 0.25, 1).orderBy("rec_id").collect()
    assert [r["bag_id"] for r in rows] == [r["rec_id"] // 200 for r in rows]


def test_bad_settings_are_refused(spark):
    with pytest.raises(ValueError):
        sampling.check_bagging("entropy", 2, True, True)
    with pytest.raises(ValueError):
        sampling.check_bagging("gain", 2, False, True)
    with pytest.raises(ValueError):
        sampling.bag_by_partition(spark.range(0, 10, numPartitions=2).withColumnRenamed("id", "rec_id"), 4, 0.25)


def test_strata_have_their_own_rates(ids):
    drawn = sampling.stratified_resample(ids, {0: 2.0, 1: 0.25}, 5).groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in drawn}
    assert abs(sizes[0] - 20000) < 800 and abs(sizes[1] - 2500) < 250


def test_balancing_fractions():
    assert sampling.balancing_fractions({0: 100, 1: 25}, "over") == {0: 1.0, 1: 4.0}
    assert sampling.balancing_fractions({0: 100, 1: 25}, "under") == {0: 0.25, 1: 1.0}


def test_folds_partition_the_records(ids):
    folded = sampling.kfold(ids, 10)
    assert folded.select("fold").distinct().count() == 10
    training = sampling.training_folds(folded, 10)
    assert training.count() == 9 * 20000
    assert training.join(folded, ["rec_id", "fold"]).isEmpty()


def test_train_test_split_covers_everything(ids):
    train, test = sampling.train_test_split(ids, 0.7, 1)
    assert train.count() + test.count() == 20000
    assert abs(train.count() - 14000) < 400


def test_even_dealing(spark):
    """With copies, null and repeated ids: the sample is the same, the sizes differ by one at most."""
    rows = [(None if i % 97 == 0 else i // 2, i) for i in range(700)]
    tx = spark.createDataFrame(rows, "rec_id bigint, v bigint").repartition(5)
    by_hash, even = (sampling.bag_sample(tx, 6, 0.3, True, 3, even=e) for e in (False, True))
    sizes = [r["count"] for r in even.groupBy("bag_id").count().collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1
    assert even.columns == by_hash.columns
    assert even.drop("bag_id").exceptAll(by_hash.drop("bag_id")).isEmpty() and even.count() == by_hash.count()
