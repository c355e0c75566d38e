"""Divergence of sources against a plain reading, with digests wide and narrow."""

import random
import re
from collections import Counter

import duckdb

from ruleloom.llm import op12_divergence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows):
    """Sorted (lang, source, part, item, value, rank) of (text, lang, source) rows, over every kept term in every group."""
    count, df, groups = {}, Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))
        groups.add((lang, source))
        count.setdefault((lang, source), Counter()).update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (at, t), n in df.items() if at == lang and n >= 3]
        own = {s: count[lang, s] for at, s in groups if at == lang}

        def share(counter, kept=kept):
            total = sum(counter[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 1) // total for t in kept}

        shares = {s: share(c) for s, c in own.items()}
        whole = share(sum(own.values(), Counter()))
        for s, p in shares.items():
            pair = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            term = [(-((p[t] - whole[t]) ** 2 // whole[t]), t) for t in kept if own[s][t] and p[t] > whole[t]]
            for part, ranked in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def invented(seed, documents, words):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 5))) for _ in range(words)]
    rows = []
    for _ in range(documents):
        lang = rng.choice(["en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "é", "z"])
        rows.append((" ".join(rng.choices(known, weights=range(1, words + 1), k=rng.randint(0, 40))).title(), lang, source))
    return rows


def test_audit_of_the_table_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(db.sql(f"SELECT lang, source, part, item, value, rank FROM ({op12_divergence.SQL})").fetchall())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert result(op12_divergence.audit(docs)) == want == plain([(r["text"], r["lang"], r["source"]) for r in docs.collect()])


def test_digests_of_several_terms_are_split(spark):
    """With few bits most digests stand for several terms; the result is the same."""
    rows = invented(1, 150, 300)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = plain(rows)
    for bits in (64, 7, 1):
        assert result(op12_divergence.audit(docs, bits)) == want


def test_ties_at_the_last_rank(spark):
    """More terms tie at rank 200 than are returned."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)]
    rows = [(" ".join(words[:450]), "en", "a")] * 3 + [(" ".join(words[400:]), "en", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(op12_divergence.audit(docs)) == plain(rows)


def test_odd_documents(odd, none, spark):
    rows = [(r["text"], None, None) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(op12_divergence.audit(docs)) == plain(rows)
    extra = docs.selectExpr("*", "1 AS n", "2 AS digest", "'x' AS term")
    assert result(op12_divergence.audit(extra)) == plain(rows)
    assert op12_divergence.audit(docs.where("text = 'nothing like this'")).count() == 0
    lone = [("a a b", "en", "s1"), (None, "en", "s2"), ("c", "fr", "s3"), ("", "fr", None)]
    lone_docs = spark.createDataFrame(lone, "text string, lang string, source string")
    got = result(op12_divergence.audit(lone_docs))
    assert got == plain(lone) and {r[4] for r in got} == {0} and len(got) == 4


def test_shares_are_exact_beyond_long(spark):
    """Counts whose billionfold does not fit a long."""
    df = spark.createDataFrame([(10**15, 10**17, 10**6), (0, 0, 1), (7 * 10**17, 7 * 10**17 + 3, 9)], "n long, total long, kept long")
    from pyspark.sql import functions as F

    got = [r["p"] for r in df.select(op12_divergence._share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in ((10**15, 10**17, 10**6), (0, 0, 1), (7 * 10**17, 7 * 10**17 + 3, 9))]
