"""Fingerprints and licence scans against a plain reading."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ruleloom.llm import op6_licenses, op8_fingerprints
from tests_llm_plain import shingle_set

FOLDER = "/root/testdata/sf0.001"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edited(rows, result, k, tolerance):
    """Every row of `rows`, repeated ones too, has a row of its own in the result."""
    rows = sorted(rows)
    got, found = {}, result.collect()
    for r in found:
        got.setdefault((r["doc_id"], r["edited_sha256"]), []).append(r)
    assert len(found) == len(rows)
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        r = got[None if i == op8_fingerprints.NO_ID else i, hashlib.sha256(new.encode()).hexdigest()].pop()
        assert r["n_chars"] == len(text)
        exact = len(shingle_set(text) | shingle_set(new)) <= k
        assert abs(r["near_edited"] - jaccard(text, new)) < (1e-9 if exact else tolerance)
        exact = len(shingle_set(text) | shingle_set(after)) <= k
        assert abs(r["near_next"] - jaccard(text, after)) < (1e-9 if exact else tolerance)
    return {r["doc_id"]: r for r in found}


def test_edited_texts_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = check_edited(rows, op8_fingerprints.edited(docs), 128, 0.15)
    prints = {}
    for i, text in rows:
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_edited_odd_rows(odd, none, spark):
    rows = [(op8_fingerprints.NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd.collect()]
    check_edited(rows, op8_fingerprints.edited(odd), 128, 0.15)
    assert op8_fingerprints.edited(none).count() == 0
    only = op8_fingerprints.edited(odd.where("doc_id = 6")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    twice = op8_fingerprints.edited(odd.where("doc_id = 5")).collect()
    assert [r["near_next"] for r in twice] == [1.0, 1.0]
    empty = op8_fingerprints.edited(odd.where("doc_id = 1")).collect()[0]
    assert (empty["fingerprint"], empty["near_edited"]) == ("", 1.0)


def test_edited_rows_of_missing_and_repeated_ids(spark):
    """Each row without id, and each text of an id, is a document: none is left out."""
    rows = [(None, f"text {k} of nobody with {k * k} more words") for k in (3, 1, 2, 2)]
    rows += [(7, "first text of seven in here"), (7, "second and other text of seven"), (5, "only text of five here"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted((op8_fingerprints.NO_ID if i is None else i, t or "") for i, t in rows)
    want = []
    for at, (i, text) in enumerate(order):
        after, n = order[(at + 1) % len(order)][1], len(text) // 4
        new = text[: len(text) - n] + after[:n]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(text, new), jaccard(text, after)))
    got = [
        (op8_fingerprints.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])
        for r in op8_fingerprints.edited(docs).collect()
    ]
    assert sorted(got) == sorted(want)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(
        op8_fingerprints.sketch(F.col("a")).alias("a"), op8_fingerprints.sketch(F.col("b")).alias("b")
    )
    r = rows.select(
        op8_fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"),
        op8_fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        op8_fingerprints.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    assert abs(r["j"] - 1 / 3) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 1996) < 600
    texts = [(k % 2, " ".join(rng.sample(words, 60))) for k in range(10)]
    df = spark.createDataFrame(texts, "g int, text string").select("g", op8_fingerprints.sketch(F.col("text")).alias("sketch"))
    merged = {r["g"]: r["sketch"] for r in op8_fingerprints.merge_groups(df, ["g"]).collect()}
    all_ = {g: sorted({h for r in df.collect() if r["g"] == g for h in r["sketch"]})[:128] for g in (0, 1)}
    assert merged == all_


def plain_base(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({label for _, label in found})


def check_base(rows, result):
    got = {}
    for r in result.collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        r = got[i][0]
        n, places, first, last, labels = plain_base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    return got


def test_licences_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = check_base(rows, op6_licenses.scan(docs))
    assert len(got) == len(rows)
    gpl = [i for i, t in rows if "GNU General Public License, version 3" in t]
    assert gpl and all("gpl-3" in got[i][0]["labels"] for i in gpl)


def test_licences_of_odd_rows(odd, none):
    got = check_base([(r["doc_id"], r["text"]) for r in odd.collect()], op6_licenses.scan(odd))
    assert len(got[5]) == 2 and all(r[0]["labels"] == "" for r in got.values())
    assert op6_licenses.scan(none).count() == 0


def test_licence_phrases_and_notices(spark):
    apache = op6_licenses.NOTICES[2][1]
    texts = [
        "x cc-by-nc y CC BY NC cc by nc", "Under the MIT-License; under THE mit license" * 30, "é license apache  license,version 2",
        "code. " + apache + ". more", "code. " + apache.replace("not use", "certainly not use") + ". more", "the license in compliance with the file",
        "It is Licensed under Creative Commons, Attribution-NonCommercial 4.0.", "under the mit", "mit license under the", "der mit dem license",
    ]
    rng = random.Random(3)
    texts += [" ".join(rng.choices("under the mit license apache version 2 cc by nc".split(), k=60)) for _ in range(60)]
    rows = list(enumerate(texts))
    got = check_base(rows, op6_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[3][0]["labels"] == got[4][0]["labels"] == "apache-2"
    assert got[5][0]["labels"] == "" and got[5][0]["score"] == 0
    assert got[9][0]["labels"] == ""


def test_licences_of_a_text_with_several_notices(spark):
    """A notice of rare words beside one whose words are all common in the other documents."""
    rare, common = op6_licenses.NOTICES[1], op6_licenses.NOTICES[3]
    words = " ".join(sorted(op6_licenses.spelled(common[1])))
    rows = [(0, f"{rare[1]}. And then. {common[1]}.")] + [(1 + i, words) for i in range(79)]
    got = op6_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").collect()
    assert [r["labels"] for r in got] == ["gpl-3,mit"]


def plain_labels(text):
    """A plain scanner: base phrases word by word, notices by all mandatory phrases within the notice's length of their places."""
    own = op6_licenses.spelled(text or "")
    at = lambda phrase: [i for i in range(len(own)) if own[i : i + len(phrase)] == phrase]
    found = {label for phrase, label in PHRASES.items() if at(op6_licenses.spelled(phrase))}
    for label, notice, phrases in op6_licenses.NOTICES:
        whole = op6_licenses.spelled(notice)
        keys = [op6_licenses.spelled(p) for p in phrases]
        dues = [next(i for i in range(len(whole)) if whole[i : i + len(k)] == k) for k in keys]
        places = [[p - d for p in at(k)] for k, d in zip(keys, dues, strict=True)]
        if any(all(any(abs(q - p) <= len(whole) for q in qs) for qs in places) for p in places[0]):
            found.add(label)
    return ",".join(sorted(found))


def test_licence_labels_against_a_plain_scanner(spark):
    rng, filler = random.Random(4), "lorem the of version to any software and in".split()
    texts = ["GNU Lesser General Public License version 3", "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD-3-Clause", "Zlib", ""]
    for _, notice, _ in op6_licenses.NOTICES:
        own = notice.split()
        texts += [notice, " ".join(rng.choices(filler, k=70) + own + rng.choices(filler, k=9))]
        texts.append(" ".join(rng.sample(own, len(own))))
    for number in (8, 10):  # words put in between the mandatory phrases
        own = op6_licenses.NOTICES[number][1].split()
        texts.append(" ".join(own[:9] + ["lorem"] * 6 + own[9:]))
    texts.append(" ".join(n for _, n, _ in op6_licenses.NOTICES) * 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op6_licenses.scan(docs).collect()}
    assert got == {i: plain_labels(t) for i, t in enumerate(texts)}
    assert (got[0], got[1], got[2], got[3]) == ("lgpl-3", "mit", "bsd", "") and got[len(texts) - 3] == "bsd" and got[len(texts) - 2] == "isc"
