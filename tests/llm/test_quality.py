"""Quality rules and the discriminant: counts against a plain reading, models on held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ruleloom.llm import op3_rules, op10_discriminant
from ruleloom.llm.batches import Words, utf8

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check_counts(rows, result):
    got = {}
    for r in result.collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        r = got[i][0]
        want = plain(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, text)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_counts_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    result = op3_rules.quality_rules(odd, odd, labels)
    check_counts([(r["doc_id"], r["text"]) for r in odd.collect()], result)
    assert result.where("doc_id = 5").count() == 2
    assert op3_rules.quality_rules(none, none, labels).count() == 0


def test_counts_of_random_texts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(["a ", "b ", "é ", "\n", "# ", "cc\n", " <x> ", "\t"], k=rng.randint(0, 90)))) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choices("xyz", k=40))) for i in range(50)]
    check_counts(rows, op3_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), None))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held(labels):
    return {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_rules_on_held_out_labels(tables):
    docs, labels = tables
    result = op3_rules.quality_rules(docs, docs, labels)
    rows = {r["doc_id"]: r for r in result.collect()}
    assert len(rows) == docs.count()
    truth = held(labels)
    good = [rows[i]["kept"] for i, q in truth.items() if q == 1]
    bad = [rows[i]["kept"] for i, q in truth.items() if q == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5
    kept = op3_rules.accepted(docs, op3_rules.train(docs, labels))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in rows.items() if r["kept"]}


def words_of(texts):
    return Words(*utf8(pa.array(texts)))


def test_logits_are_plain_sums():
    rng = np.random.default_rng(5)
    model = op3_rules.Model(rng.normal(size=op3_rules.FAMILIES * op3_rules.SLOTS), 0.25, 1.0, 0.0)
    texts = ["", "a", "né é né", "Ünï çødé 語 語\n\t語 😀😀x", "ab ab  ab cd " * 3, None, "😀", "é語"]

    def weight(part, family):
        slot, doc = list(op3_rules.slots(words_of([part])))[family]
        assert len(slot) == 1, part
        return model.weights[slot[0]]

    for text, got in zip(texts, op3_rules.logits(words_of(texts), model), strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [words, [" ".join(words[i : i + 2]) for i in range(len(words) - 1)], [text[i : i + 3] for i in range(len(text) - 2)]]
        want = 0.25 + sum(sum(weight(g, k) for g in part) / len(part) for k, part in enumerate(grams) if part)
        assert abs(got - want) < 1e-9, text


def test_shares_of_texts():
    doc, slot, share = op3_rules.shares(words_of(["a b a", "", "é語 é語"]))
    for i, families in ((0, 3), (1, 0), (2, 3)):
        assert abs(share[doc == i].sum() - families) < 1e-6
    assert len(set(zip(doc, slot, strict=True))) == len(slot)


def test_repeated_ids_are_fitted_once(tables, spark):
    docs, labels = tables
    some = labels.limit(60)
    small = docs.join(some.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    once = op3_rules.train(small, some)
    many = op3_rules.train(small.union(small).union(small), some)
    assert np.array_equal(once.weights, many.weights) and (once.scale, once.shift) == (many.scale, many.shift)


def test_platt_keeps_order_and_level():
    rng = np.random.default_rng(2)
    logit = rng.normal(size=4000) * 3
    label = (rng.random(4000) < 1 / (1 + np.exp(-0.5 * logit - 1))).astype(float)
    scale, shift = op3_rules.platt(logit, label)
    assert abs(scale - 0.5) < 0.1 and abs(shift - 1) < 0.15


def test_discriminant_on_held_out_labels(tables):
    docs, labels = tables
    rows = {r["doc_id"]: r for r in op10_discriminant.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    truth = held(labels)
    score = np.array([rows[i]["score"] for i in truth])
    y = np.array(list(truth.values()))
    pairs = (score[y == 1][:, None] > score[y == 0][None]) + 0.5 * (score[y == 1][:, None] == score[y == 0][None])
    assert pairs.mean() > 0.9
    assert np.mean([rows[i]["predicted"] for i, q in truth.items() if q == 1]) > 0.9


def test_discriminant_scores_are_density_differences():
    rng = np.random.default_rng(1)
    p = len(op10_discriminant.NAMES)
    data = {k: rng.normal(size=(200, p)) @ np.diag(rng.uniform(0.5, 2, p)) + k for k in (0, 1)}
    sums = {k: (len(x), x.sum(0), x.T @ x) for k, x in data.items()}
    model = op10_discriminant.fit(sums, 0.4, 0.05)
    own = {k: np.cov(x.T, bias=True) for k, x in data.items()}
    both = (own[0] + own[1]) / 2
    density = []
    x = rng.normal(size=(20, p))
    for k in (0, 1):
        cov = 0.95 * (0.6 * own[k] + 0.4 * both) + 0.05 * np.diag(np.diag(both)) + 1e-9 * np.eye(p)
        d = x - data[k].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


def test_discriminant_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = op10_discriminant.classify(odd, labels).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows}) == 1
    assert op10_discriminant.classify(none, labels).count() == 0
    assert op10_discriminant.accepted(odd, 0.5).columns == odd.columns
