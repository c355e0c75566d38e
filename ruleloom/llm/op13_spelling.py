"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself.

Words are counted where they are read, in Arrow batches, and summed by Spark. The composed machine is enumerated in
partitions of its states after the first symbols. While both sides still read the same, a state is a prefix: a
prefix is lengthened, symbol by symbol, until at most LEAF words begin with it, and the words below it are one partition: their
minimised acceptor is composed with the transducer and itself in one task. Where the edit falls into the prefix, both sides
are in two different states and can but read the same rest from there: the intersection of two right languages, which
Spark takes by grouping and joining on (prefix, rest). Of one place and rest there are at most as many words as letters.
So every pair is enumerated in one place, no partition grows with the vocabulary, and no pairs but links are formed.

Null texts have no words; a null id is written as nothing before the colon. Repeated rows count as often as they stand, texts
and runs of any length are read whole, an empty table gives an empty one. Equal counts go to the word smaller in code-point
order. Columns other than id and text are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.acceptor import Acceptor, Composition
from ruleloom.llm.batches import LOWER, Words, pieces, strings, utf8
from ruleloom.llm.tables import texts
from ruleloom.staging import stage, stage_observed

#: A word has so many code points and occurrences at least.
LENGTH, OCCURRENCES = 5, 3
#: A form has so many times the occurrences of the word it is the form of.
TIMES = 2
#: Words of one partition of the composed machine at most.
LEAF = 2000
#: One run of a document in so many loses a letter.
ERRORS = 97
#: Depths of prefixes counted in one pass.
DEPTHS = 8
#: Bytes of text counted together.
CHUNK = 8_000_000


def _letters(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, and a space in place of what is no letter: `[A-Za-z\\u00C0-\\u00FF]`, whose last part begins with byte C3."""
    lead = data == 0xC3
    inside = lead | ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0x41) & (data <= 0x5A))
    inside[1:] |= lead[:-1]
    return np.where(inside, LOWER[data], 0x20).astype(np.uint8)


def _hashes(ids: list[int | None], doc: np.ndarray, runs: list[bytes], run: np.ndarray) -> np.ndarray:
    """crc32 of `<id>:<run>` for each pair of a document and a run: the part of the id is shifted by the run's length."""
    sizes = np.array([len(r) for r in runs], np.int64)
    heads = [zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids]
    tails = np.array([zlib.crc32(r) for r in runs], np.int64)
    widest = int(sizes.max(initial=0)) + 1
    shifts, at = np.unique(doc * widest + sizes[run], return_inverse=True)
    zeros = memoryview(bytes(widest))
    moved = [zlib.crc32(zeros[: k % widest], heads[k // widest]) ^ zlib.crc32(zeros[: k % widest]) for k in shifts.tolist()]
    return np.array(moved, np.int64)[at] ^ tails[run]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of the words of each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                offsets, data = utf8(part.column("text"))
                words = Words(offsets, _letters(data))
                coded = strings(words).dictionary_encode()
                known = coded.dictionary.to_pylist()
                if not known:
                    continue
                pair, n = np.unique(words.doc * len(known) + coded.indices.to_numpy(), return_counts=True)
                doc, code = pair // len(known), pair % len(known)
                hashes = _hashes(part.column("doc_id").to_pylist(), doc, [w.encode() for w in known], code)
                wrong = hashes % ERRORS == 0
                found = dict(zip(known, np.bincount(code[~wrong], weights=n[~wrong], minlength=len(known)).astype(int).tolist(), strict=True))
                for word, h, count in zip((known[c] for c in code[wrong]), hashes[wrong].tolist(), n[wrong].tolist(), strict=True):
                    cut = word[: h % len(word)] + word[h % len(word) + 1 :]
                    found[cut] = found.get(cut, 0) + count
                rows = [(w, count) for w, count in found.items() if count and len(w) >= LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])

    return texts(docs).mapInArrow(run, "word string, n long")


def leaves(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, n, depth): symbols of the prefix under which a word's partition stands, one more than the word has if it is alone there.

    Prefixes are counted a few depths at a time, deeper ones only for words whose shorter prefixes all have more than `leaf` words.
    """
    open_, found, at = words.select("word"), [], 0
    while True:
        last = F.least(F.length("word"), F.lit(at + DEPTHS))
        begins = F.transform(F.sequence(F.lit(at + 1), last), lambda i: F.substring(F.col("word"), F.lit(1), i))
        prefixes = open_.where(F.length("word") > at).select("word", F.explode(begins).alias("prefix"))
        hot = prefixes.groupBy("prefix").agg(F.count("*").alias("size")).where(F.col("size") > leaf).select("prefix")
        deep, seen = stage_observed(
            prefixes.join(hot, "prefix").groupBy("word").agg(F.max(F.length("prefix")).alias("hot")), "hot", full=F.max("hot")
        )
        found.append(deep)
        at += DEPTHS
        if (seen["full"] or 0) < at:
            break
        open_ = deep.where(F.col("hot") == at).select("word")
    deepest = found[0]
    for more in found[1:]:
        deepest = deepest.union(more)
    deepest = deepest.groupBy("word").agg(F.max("hot").alias("hot"))
    return words.join(deepest, "word", "left").select("word", "n", (F.coalesce("hot", F.lit(0)) + 1).alias("depth"))


def _near(order: Column, word: Column) -> Column:
    """How a near word ranks: most occurrences first, then the smallest."""
    return F.struct((-order).alias("order"), word.alias("word"))


def within(words: DataFrame) -> DataFrame:
    """(word, n_near, near): links of words under one prefix, counted, with the best one of each word."""

    def run(table: pa.Table) -> pa.Table:
        skip = table["depth"][0].as_py()
        number = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        count: dict[str, int] = {}
        best: dict[str, tuple[int, str]] = {}
        prefix = next(iter(number))[:skip]
        for one, two in Composition(Acceptor(sorted(w[skip:] for w in number))).pairs():
            for word, other in ((prefix + one, prefix + two), (prefix + two, prefix + one)):
                count[word] = count.get(word, 0) + 1
                rank = (-number[other], other)
                if word not in best or rank < best[word]:
                    best[word] = rank
        found = list(count)
        return pa.table(
            {
                "word": pa.array(found, pa.string()),
                "n_near": pa.array([count[w] for w in found], pa.int64()),
                "order": pa.array([best[w][0] for w in found], pa.int64()),
                "other": pa.array([best[w][1] for w in found], pa.string()),
            }
        )

    parts = words.withColumn("leaf", F.expr("substring(word, 1, depth)")).groupBy("leaf")
    found = parts.applyInArrow(run, "word string, n_near long, order long, other string")
    return found.select("word", "n_near", F.struct("order", F.col("other").alias("word")).alias("near"))


def across(words: DataFrame) -> DataFrame:
    """(word, n_near, near): links whose edit stands in the prefix of a partition, before the states part."""
    places = F.sequence(F.lit(1), F.least(F.col("depth"), F.length("word")))
    cut = words.select("word", "n", F.explode(places).alias("place"))
    rest = F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)"))
    symbol, after = F.expr("substring(word, place, 1)"), F.expr("substring(word, place + 1, 1)")
    cut = cut.select("word", "n", "place", rest.alias("rest"), (symbol != after).alias("last_of_run"))
    # Replaced: the words with one place and rest differ in the one symbol there, so they are at most as many as letters.
    groups = cut.groupBy("place", "rest").agg(F.sort_array(F.collect_list(_near(F.col("n"), F.col("word")))).alias("all"))
    groups = groups.where(F.size("all") > 1)
    replaced = groups.select(F.posexplode("all").alias("at", "own"), "all").select(
        F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"),
        F.get("all", F.when(F.col("at") == 0, 1).otherwise(0)).alias("near"),
    )
    # Left out: what remains of the longer word is a word.
    shorter = words.select(F.col("word").alias("rest"), F.col("n").alias("n_rest"))
    met = cut.where("last_of_run").join(shorter, "rest")
    one = met.select("word", F.lit(1).cast("long").alias("n_near"), _near(F.col("n_rest"), F.col("rest")).alias("near"))
    two = met.select(F.col("rest").alias("word"), F.lit(1).cast("long").alias("n_near"), _near(F.col("n"), F.col("word")).alias("near"))
    return replaced.unionByName(one).unionByName(two)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of every word in `forms` (word, form).

    Each round follows as many forms as all rounds before it; occurrences double with each form, so few rounds are needed.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now, seen = stage_observed(now.join(further, "root", "left"), "roots", moved=F.count("far"))
        now = now.select("word", F.coalesce("far", "root").alias("root"))
        if not seen["moved"]:
            return now


def variants(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    counted = count_words(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)
    words = stage(leaves(stage(counted, "words"), leaf), "leaves")
    links = within(words).unionByName(across(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    found = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "near")
    is_form = -F.col("near.order") >= TIMES * F.col("n")
    found = found.select("word", "n", "n_near", F.when(is_form, F.col("near.word")).alias("form"), F.when(is_form, -F.col("near.order")).alias("form_n"))
    found = stage(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
