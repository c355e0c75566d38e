"""Random record sets, one per bag, mined and scored in one plan, against the single-machine models."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import coverage
from ruleloom.operators.coverage import cover
from ruleloom.operators.gain import mine_gain
from ruleloom.operators.match import index_rules, match
from ruleloom.operators.rules import rules_text
from ruleloom.operators.scoring import VoteSettings, first_match, probabilities
from ruleloom.operators.support import larger_subsets, mine_class_tokens, mine_support, partners
from ruleloom.staging import stage

SETS = 40


@pytest.fixture(scope="module")
def sets():
    return {
        s: brute.random_records(s, items=4 + s % 5, classes=2 + s % 2, fill=(0.4, 0.6, 0.8)[s % 3]) for s in range(SETS)
    }


@pytest.fixture(scope="module")
def tx(spark, sets):
    rows = [
        (f"{s}/{i}", list(items), label, s) for s, records in sets.items() for i, (items, label) in enumerate(records)
    ]
    return stage(spark.createDataFrame(rows, "rec_id string, items array<bigint>, label bigint, bag_id int"), "test")


@pytest.fixture(scope="module")
def mined(tx):
    return stage(mine_support(tx, 0.2, 0.5, 0.5), "test-rules")


def by_bag(table, level=None):
    found = defaultdict(list)
    rows = rules_text(table if level is None else table.where(F.col("level") == level))
    for r in rows.orderBy("bag_id", "level", "rank").collect():
        found[r["bag_id"]].append(r["line"])
    return found


def expected(sets, model):
    return {s: lines for s, r in sets.items() if (lines := [brute.line(*x) for x in model(r)])}


def test_support(sets, mined):
    assert by_bag(mined) == expected(sets, lambda r: brute.support_rules(r, 0.2, 0.5, 0.5))


def test_support_level_by_level(sets, tx):
    grown = mine_support(tx, 0.2, 0.5, 0.5, max_length=4, narrow=0)
    assert by_bag(grown) == expected(sets, lambda r: brute.support_rules(r, 0.2, 0.5, 0.5, 4))


@pytest.mark.parametrize("longest", [2, 10])
def test_support_of_bounded_length(sets, tx, longest):
    found = mine_support(tx, 0.2, 0.5, 0.5, max_length=longest, at_once=0)
    assert by_bag(found) == expected(sets, lambda r: brute.support_rules(r, 0.2, 0.5, 0.5, longest))


def test_support_with_more_pairs_than_are_broadcast(sets, tx):
    found = mine_support(tx, 0.2, 0.5, 0.5, max_length=4, pair_limit=1, at_once=0)
    assert by_bag(found) == expected(sets, lambda r: brute.support_rules(r, 0.2, 0.5, 0.5, 4))


def test_no_subset_with_an_infrequent_pair_is_written(spark):
    frequent = {(5, 3), (5, 2), (3, 2), (2, 0), (5, 0)}
    rows = [(0, [5, 3, 2, 0], 0, 1), (0, [5, 4, 3, 2], 1, 2), (0, [4, 1], 0, 1), (1, [2, 1, 0], 0, 1)]
    baskets = spark.createDataFrame(rows, "bag_id int, ranks array<int>, label int, n long")
    ranks = spark.createDataFrame([(b, r) for b in (0, 1) for r in range(6)], "bag_id int, rank int")
    short = spark.createDataFrame([(0, list(p)) for p in frequent], "bag_id int, itemset array<int>")
    found = larger_subsets(baskets, partners(ranks, short), 10)
    want = [
        (b, c, label, n)
        for b, items, label, n in rows
        for k in range(3, len(items) + 1)
        for c in brute.combinations(items, k)
        if b == 0 and all(p in frequent for p in brute.combinations(c, 2))
    ]
    assert sorted((r["bag_id"], tuple(r["itemset"]), r["label"], r["n"]) for r in found.collect()) == sorted(want)
    assert 0 < len(want) < sum(1 for _, items, _, _ in rows for k in range(3, 5) for _ in brute.combinations(items, k))


def test_support_with_joined_ranks(sets, tx):
    joined = mine_support(tx, 0.3, 0.5, 0.0, map_limit=0)
    assert by_bag(joined) == expected(sets, lambda r: brute.support_rules(r, 0.3, 0.5, 0.0))


@pytest.mark.parametrize(("support", "chi2"), [(0.05, 0.0), (0.2, 1.0)])
def test_gain(sets, tx, support, chi2):
    found = by_bag(mine_gain(tx, support, 0.4, chi2))
    assert found == expected(sets, lambda r: brute.gain_rules(r, support, 0.4, chi2))


def test_gain_in_rounds_of_one_depth(sets, tx, monkeypatch):
    monkeypatch.setattr("ruleloom.operators.gain.DEPTHS_PER_ROUND", 1)
    found = by_bag(mine_gain(tx, 0.05, 0.4, 0.0, map_limit=0))
    assert found == expected(sets, lambda r: brute.gain_rules(r, 0.05, 0.4, 0.0))


def test_class_tokens_give_every_frequent_class(sets, tx):
    import math
    from collections import Counter

    want = {}
    for s, records in sets.items():
        n, least = len(records), math.ceil(0.25 * len(records))
        keys = {frozenset(c) for i, _ in records for k in range(1, len(i) + 1) for c in brute.combinations(i, k)}
        rules = []
        for key in keys:
            hits = Counter(label for items, label in records if key <= set(items))
            for con, k in hits.items():
                m = brute.measures(sum(hits.values()), k, sum(x == con for _, x in records), n)
                if k >= least and brute.good(m[1], m[2], 0.5, 0.5):
                    rules.append((key, con))
        if rules:
            want[s] = Counter(rules)
    got = defaultdict(Counter)
    for r in mine_class_tokens(tx, 0.25, 0.5, 0.5).collect():
        got[r["bag_id"]][(frozenset(r["antecedent"]), r["consequent"])] += 1
    assert got == want


def test_coverage_of_own_bag(sets, tx, mined):
    kept = stage(cover(mined, tx), "test-covered")
    for level in (1, 2):
        want = expected(sets, lambda r, at=level - 1: brute.covered(brute.support_rules(r, 0.2, 0.5, 0.5), r)[at])
        assert by_bag(kept, level) == want


@pytest.fixture
def short_blocks(monkeypatch):
    monkeypatch.setattr(coverage, "FIRST_BLOCK", 2)
    monkeypatch.setattr(coverage, "GROWTH", 2)


def test_coverage_by_blocks_matches_up_to_the_claim(sets, tx, mined, short_blocks):
    """Each record meets the rules of the blocks up to the one that claims it, and none behind."""
    facts = []
    kept = stage(cover(mined, tx, facts=facts), "test-covered")
    matches = 0
    for records in sets.values():
        rules = brute.support_rules(records, 0.2, 0.5, 0.5)
        used = brute.covered(rules, records)[0]
        for items, label in {(tuple(sorted(i)), x) for i, x in records}:
            applying = [k for k, r in enumerate(rules) if set(r[0]) <= set(items)]
            claim = next((k for k in applying if rules[k] in used), len(rules))
            ends = [2 * (2**b - 1) for b in range(1, 20)]
            matches += sum(k < next(e for e in ends if e > claim) for k in applying)
    assert len(facts) > 3 and sum(f["matches"] for f in facts) == matches
    assert [f["records"] for f in facts] == sorted((f["records"] for f in facts), reverse=True)
    for level in (1, 2):
        want = expected(sets, lambda r, at=level - 1: brute.covered(brute.support_rules(r, 0.2, 0.5, 0.5), r)[at])
        assert by_bag(kept, level) == want


def test_coverage_by_blocks_on_common_data(spark, sets, mined, short_blocks):
    test_coverage_on_common_data(spark, sets, mined)


def test_coverage_on_common_data(spark, sets, mined):
    data = brute.random_records(999, n=25, items=8, classes=3)
    common = spark.createDataFrame([(list(i), x) for i, x in data], "items array<bigint>, label bigint")
    kept = stage(cover(mined, common, shared=True), "test-covered")
    for level in (1, 2):
        want = expected(sets, lambda r, at=level - 1: brute.covered(brute.support_rules(r, 0.2, 0.5, 0.5), data)[at])
        assert by_bag(kept, level) == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_match_by_broadcast_and_by_salted_shuffle(sets, tx, mined, limit):
    index = index_rules(mined, ["bag_id", "rank"], [], limit)
    assert index.small == (limit > 0)
    rows = match(tx.select("rec_id", "bag_id", "items"), index, on=["bag_id"]).select("rec_id", "rank").collect()
    want = [
        (f"{s}/{i}", k + 1)
        for s, r in sets.items()
        for k, rule in enumerate(brute.support_rules(r, 0.2, 0.5, 0.5))
        for i, (items, _) in enumerate(r)
        if set(rule[0]) <= set(items)
    ]
    assert sorted(map(tuple, rows)) == sorted(want)


@pytest.mark.parametrize(
    ("voting", "metric", "weight", "limit"),
    [
        ("max", "confidence", "none", 10**6),
        ("max", "confidence", "none", 0),
        ("max", "support", "none", 10**6),
        ("mean", "confidence", "numRules", 10**6),
        ("mean", "support", "numRules", 0),
        ("min", "confidence", "none", 10**6),
    ],
)
def test_probabilities(sets, tx, mined, voting, metric, weight, limit):
    classes, default = [0, 1, 2], [0.2, 0.5, 0.3]
    model = mined.withColumn("model", F.col("bag_id"))
    scored = probabilities(
        tx.withColumn("model", F.col("bag_id")).drop("bag_id"), model, classes,
        VoteSettings(voting, metric, weight), default, ("rec_id",), ("model",), limit,
    )
    got = {r["rec_id"]: r["probability"] for r in scored.collect()}
    assert len(got) == sum(map(len, sets.values()))
    for s, records in sets.items():
        rules = brute.support_rules(records, 0.2, 0.5, 0.5)
        for i, (items, _) in enumerate(records):
            want = brute.probability(rules, items, classes, voting, metric, weight, default)
            assert got[f"{s}/{i}"] == pytest.approx(want, abs=1e-12)
            assert sum(got[f"{s}/{i}"]) == pytest.approx(1.0, abs=1e-10)


def test_first_match_prefers_used_rules(sets, tx, mined):
    kept = stage(cover(mined, tx), "test-covered").withColumn("model", F.col("bag_id"))
    data = tx.withColumn("model", F.col("bag_id")).drop("bag_id")
    got = {
        r["rec_id"]: r["prediction"]
        for r in first_match(data, kept, [0, 1, 2], 7, ("rec_id",), ("model",)).collect()
    }
    for s, records in sets.items():
        used, spare = brute.covered(brute.support_rules(records, 0.2, 0.5, 0.5), records)
        for i, (items, _) in enumerate(records):
            want = next((r[1] for r in used + spare if set(r[0]) <= set(items)), 7)
            assert got[f"{s}/{i}"] == want
