"""Nearest neighbours against all cosines."""

import math
import random

import numpy as np

from ruleloom.llm import hnsw, op11_neighbours

KIND = "vec_id long, embedding array<float>, rank int, shard string"
FIFTY = "vec_id % 50 == 0"


def exact(rows, k, asks):
    """{query: [(vec_id, cosine)]} of distinct (id, vector) rows; rows are (id, tuple)."""
    rows = sorted({(i, tuple(v)) for i, v in rows})

    def cosine(v, w):
        v, w = np.array(v), np.array(w)
        return (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))

    found = []
    for i, v in rows:
        if asks(i):
            others = [(-cosine(w, v), j, w) for j, w in rows if len(w) == len(v) and (j, w) != (i, v)]
            found.append((i, [(j, -s) for s, j, _ in sorted(others)[:k]]))
    return found


def answers(result):
    got = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def check(rows, result, k, asks, recall=1.0):
    got, want = answers(result), exact(rows, k, asks)
    hits = total = 0
    for i, best in want:
        mine = got.get(i, [])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        hits += len({j for _, j, _ in mine} & {j for j, _ in best})
        total += len(best)
        if recall == 1.0:
            assert [j for _, j, _ in mine] == [j for j, _ in best]
            assert all(math.isclose(s, t, rel_tol=1e-12, abs_tol=1e-12) for (_, _, s), (_, t) in zip(mine, best, strict=True))
    assert set(got) <= {i for i, _ in want} and hits >= recall * total


def test_neighbours_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(rows, op11_neighbours.neighbours(table, 5, FIFTY), 5, lambda i: i % 50 == 0, 0.98)


def test_recall_over_several_shards_with_near_copies(spark, monkeypatch):
    monkeypatch.setattr(op11_neighbours, "SPREAD", 10)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    vectors = [*rng.normal(size=(1200, 24)), *(centre + 0.02 * rng.normal(size=(600, 24)))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    result = op11_neighbours.neighbours(table, 5, FIFTY)
    check(rows, result, 5, lambda i: i % 50 == 0, 0.95)


def test_odd_vectors(spark):
    """Unusable vectors take no part; equal vectors, multiples, repeats, shared ids, lengths and ties."""
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, nan, 0.0], [inf, 1.0, 0.0], [1.0, -inf, 0.0]]
    good = [(50, [1.0, 0.0, 0.0]), (51, [1.0, 0.0, 0.0]), (52, [1.0, 0.0, 0.0]), (53, [0.0, 1.0, 0.0]), (100, [2.0, 0.0, 0.0])]
    good += [(54, [0.0, -1.0, 0.0]), (55, [1.0, 1.0, 0.0]), (55, [1.0, 1.0, 0.0]), (150, [0.5, 0.25, 1.0]), (150, [0.5, 0.25, -1.0])]
    good += [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (250, [3.0]), (300, [1e-30, 0.0, 0.0]), (56, [1e30, 1e30, 0.0]), (-50, [0.0, 0.0, -0.0 + 1.0])]
    rows = [(1000 + 50 * i, v, 1, "x") for i, v in enumerate(bad)] + [(i, v, 2, None) for i, v in good] + [(None, [1.0, 0.0, 0.0], 1, "x")]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    result = op11_neighbours.neighbours(table, 3, FIFTY)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in result.collect())
    want = sorted((i, n + 1, j) for i, best in exact(single, 3, lambda i: i % 50 == 0) for n, (j, _) in enumerate(best))
    assert got == want
    assert not any(i == 250 for i, _, _ in got) and [j for i, _, j in got if i == 200] == [201]
    assert op11_neighbours.neighbours(table.where("vec_id < -99"), 3, FIFTY).count() == 0
    assert op11_neighbours.neighbours(table.where("vec_id >= 1000"), 3).count() == 0


def test_a_hot_vector(spark):
    """A third of the rows are one vector: all have the smallest ids of it, all are asked."""
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    result = op11_neighbours.neighbours(table, 5, "vec_id % 2 == 0")
    got = answers(result)
    assert len(got) == 300
    assert [j for _, j, _ in got[6]] == [0, 3, 9, 12, 15] and [j for _, j, _ in got[594]] == [0, 3, 6, 9, 12]
    check(rows, result, 5, lambda i: i % 2 == 0, 0.98)


def test_graph_is_flat_and_hierarchical():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    level = np.sort(np.floor(-np.log(rng.random(700)) / math.log(8)).astype(int))[::-1]
    links = hnsw.build(x, level, 8, 50)
    assert [len(layer) for layer in links] == [(level >= at).sum() for at in range(level[0] + 1)]
    for at, layer in enumerate(links):
        assert layer.shape[1] == (8 if at else 16) and layer.max() < len(layer)
        for i, row in enumerate(layer):
            own = row[row >= 0]
            assert i not in own and len(set(own)) == len(own)
    found, sim = hnsw.nearest(links, x, x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) > 0.97
    assert (np.diff(sim, axis=1) <= 0).all()
    assert (hnsw.nearest(hnsw.build(x[:3], level[:3] * 0, 8, 50), x[:3], x[:1], 10)[0][0][3:] == -1).all()
