"""Stages of the corpus pipeline on a small table and on odd rows; queries are registered and run."""

import corpus_pipeline
import pytest
from ruleloom.llm import op10_discriminant, queries
from ruleloom.staging import stage
from tests_llm_plain import shingle_set

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    current, sizes = docs, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = stage(function(spark, current, FOLDER), name)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        assert all(before[i] == r for i, r in rows.items()) and set(rows) <= {r["doc_id"] for r in current.collect()}
        if name == "near_duplicates":
            check_one_of_each_group([(r["doc_id"], r["text"]) for r in current.collect()], set(rows))
        current = out
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > 0.6 * sizes[0] and sizes[3] > 0.5 * sizes[0]
    packed = corpus_pipeline.packing(spark, current, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in current.collect()}
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def check_one_of_each_group(rows, kept):
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
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if find(i) == i}


@pytest.mark.parametrize("number", range(4))
def test_stages_take_odd_rows(spark, odd, none, number):
    name, function = corpus_pipeline.STAGES[number]
    for docs in (odd, none):
        out = function(spark, docs, FOLDER)
        if number < 3:
            assert out.columns == docs.columns
        assert out.count() >= 0
    if name == "near_duplicates":
        out = function(spark, odd, FOLDER).collect()
        assert len({r["doc_id"] for r in out}) == len(out)


def test_classifier_learns_without_a_second_worker_in_a_task(spark, tmp_path, monkeypatch):
    """The moments are summed over staged statistics: no task holds a Python worker for each of both."""
    docs = spark.createDataFrame([(k, f"{'Some words. ' * (k % 7 + 1)} {'x' * (k % 5)} {k}") for k in range(60)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plans, moments = [], op10_discriminant.moments

    def watched(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return moments(rows)

    monkeypatch.setattr(op10_discriminant, "moments", watched)
    out = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    model = op10_discriminant.learn(op10_discriminant.features(docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = op10_discriminant.score(op10_discriminant.features(docs), model).where("predicted = 1")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in want.collect())
    assert "MapInArrow" not in plans[0] and "MapInArrow" in plans[1]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
