"""Near duplicates against all pairs on full sets."""

import random

import pytest

from ruleloom.llm import op2_neardup
from ruleloom.llm.components import components
from tests_llm_plain import shingle_set


def brute(rows, percent):
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.randint(3, 220))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            text = " ".join(text) + (" \n" + common if rng.random() < 0.3 else "")
            rows.append((len(rows) * 3 + 1, text.upper() if rng.random() < 0.2 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_of_random_corpora(spark, percent):
    rows = corpus(percent)
    got = op2_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = brute(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(i != c for i, (_, c) in want.items()) > 30


def test_group_that_needs_more_than_its_first_pivot(spark):
    """A chain of texts, each like its neighbours only, in tables they all share parts of."""
    words = [f"c{k}" for k in range(260)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(30)]
    got = op2_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 85)


def test_odd_rows(odd, none, spark):
    got = {}
    for r in op2_neardup.near_duplicates(odd, 85).collect():
        got.setdefault(r["doc_id"], []).append(r)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    want = brute(dict(rows).items(), 85)
    assert {i: (r[0]["n_shingles"], r[0]["component_id"]) for i, r in got.items() if i is not None} == want
    assert len(got[5]) == 2 and got[None][0]["kept"] and got[None][0]["component_id"] is None
    assert op2_neardup.near_duplicates(none).count() == 0
    kept = op2_neardup.deduplicated(odd, 85)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert kept.where("doc_id is null").count() == 1


def test_different_texts_that_share_an_id(spark):
    """Links of every text of an id count; texts that are no copies of another all stay."""
    words = [f"v{k}" for k in range(300)]
    a, b, c = (" ".join(words[k : k + 60]) for k in (0, 100, 200))
    rows = [(5, a), (5, b), (7, f"{a} more"), (9, f"{b} more"), (3, c), (3, c), (None, a), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op2_neardup.near_duplicates(docs).collect()), key=repr)
    want = [(5, 56, 5), (5, 56, 5), (7, 57, 5), (9, 57, 5), (3, 56, 3), (3, 56, 3), (None, 56, None), (8, 0, 8), (8, 0, 8)]
    assert got == sorted(want, key=repr)
    kept = op2_neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert left == sorted([(5, a), (5, b), (3, c), (None, a), (8, None), (8, "")], key=repr)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in [(40, 30), (200, 190), (60, 59)]:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 59 else [(k, k + 1) for k in range(59)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}
