"""Spelling variants against a plain reading and all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

from ruleloom.llm import op13_spelling
from ruleloom.llm.acceptor import Acceptor, Composition

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(n):
    """(word, form, root, n, n_near, form_n), by the near words of each word among those that share a deletion."""
    cuts = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cuts.setdefault(x, []).append(w)
    links = {w: set() for w in n}
    for group in cuts.values():
        for u, v in itertools.combinations(group, 2):
            if near(u, v):
                links[u].add(v)
                links[v].add(u)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return sorted(rows)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain(vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert len(want) > 100 and any(r[1] for r in want)
    assert result(op13_spelling.variants(docs)) == want
    assert result(op13_spelling.variants(docs, leaf=5)) == want


def test_variants_in_partitions_of_every_size(spark):
    """Families of words with long common beginnings and ends, runs of letters, words that begin others; chains of forms."""
    rng = random.Random(5)
    stems = ["connection", "aaaaaaaaaa", "banana", "preprepre", "ÀéÿØstraße", "zzzzz", "abcdefghij", "abcdefghijklmnopqrst"]
    words = Counter()
    for _ in range(400):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "aa"])
        words["".join(w)] += 3 * 2 ** rng.randint(0, 6)
    texts = [" ".join([w] * c) for w, c in words.items()]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(vocabulary(rows))
    assert any(r[2] != r[1] and r[1] for r in want)  # chains
    for leaf in (1, 7, 2000):
        assert result(op13_spelling.variants(docs, leaf)) == want


def test_odd_documents(odd, none, spark):
    want = plain(vocabulary([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert result(op13_spelling.variants(odd)) == want
    assert op13_spelling.variants(none).count() == 0
    long = "y" * 30_000
    rows = [(1, f"{long} {long}x ×÷× ÷{long}"), (2, f"{long} {long}x"), (3, f"{long}x, {long}xz"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op13_spelling.variants(docs)) == plain(vocabulary(rows))


def test_acceptor_is_minimal_and_pairs_are_complete():
    rng = random.Random(3)
    for _ in range(200):
        letters = "abc"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 50))})
        machine = Acceptor(words)
        assert sorted(machine.words()) == words
        tails = {frozenset(w[k:] for w in words if w.startswith(p)) for v in words for k in range(len(v) + 1) for p in [v[:k]]}
        assert len(machine.next) == max(len(tails), 1)
        got = sorted(tuple(sorted(p)) for p in Composition(machine).pairs())
        assert got == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))
