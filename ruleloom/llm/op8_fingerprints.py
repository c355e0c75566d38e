"""Document fingerprints: bottom-k sketches of shingle hashes, by built-in functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct shingles (runs of five words, A-Z lowered;
a text with fewer words is one shingle, one without words has none). Sketches of parts merge into the sketch of the whole.
From two sketches follow estimates of resemblance and containment, from one the number of distinct shingles; all are exact
while a text has at most k shingles. A fingerprint is the sketch's bytes in base64.

Null texts are empty: their sketch is empty, their fingerprint an empty string, and two empty sketches are alike (1.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ruleloom.llm.tables import texts
from ruleloom.operators.indexing import global_index
from ruleloom.staging import stage

K = 128
WIDTH = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The key under which rows without an id stand in the order of documents: before all others.
NO_ID = -(2**63)


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; white space is space, tab, line feed, VT, FF and CR."""
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _once(value: Column, then) -> Column:
    """then(value) with the value computed once, not for every use of it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text, as array<long>."""

    def shingled(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(runs)

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(_once(hashed, shingled))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(by..., sketch) over all rows (by..., sketch): the k smallest hashes of each group, cut to k in every task first."""
    hashes = sketches.select(*by, F.explode("sketch").alias("_h")).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_h"))
    least = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over the size of the union."""

    def share(pair: Column) -> Column:
        both = merge(pair["a"], pair["b"], k)
        common = F.array_intersect(F.array_intersect(both, pair["a"]), pair["b"])
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(both))

    return _once(F.struct(a.alias("a"), b.alias("b")), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    largest = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for a text without shingles."""
    j = resemblance(a, b, k)
    size, other = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (size + other) / ((1 + j) * size)))


def fingerprint(a: Column) -> Column:
    """The sketch as a string."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    return texts(docs).select("doc_id", fingerprint(sketch(F.col("text"), k)).alias("fingerprint"))


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is replaced by the head of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Every row is a document,
    also one without id or one that repeats another; they stand in the order of id and text, rows without id before all others.
    The next one of the last is the first; an only document is its own next, and an empty table gives an empty one. Very long
    texts are shingled whole. Columns other than id and text are left behind, whatever their names.

    Only ids and lengths are put in order, with the texts too if ids are missing or repeated. A document hands its head and
    its sketch to the one before it by an equi-join. The texts are shuffled once: both joins read the same exchange of (key,
    text), and the id comes in with the order.
    """
    rows = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = stage(rows.select("doc_id", "key", F.length("text").alias("n_chars")), "lengths")
    if lengths.groupBy("key").count().where("count > 1").limit(1).count():
        rows = global_index(rows.drop("key"), [F.asc_nulls_first("doc_id"), F.asc("text")], "key")
        lengths = stage(rows.select("doc_id", "key", F.length("text").alias("n_chars")), "lengths")
    base = rows.select("key", "text")
    order = stage(global_index(lengths, [F.asc("key")], "place"), "order")
    total = order.count()
    after = order.select(F.col("key").alias("next_key"), F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"))
    borrowed = F.floor(F.col("n_chars") / 4).cast("int").alias("borrowed")
    need = order.join(after, "place").select("next_key", F.col("key").alias("owner"), "doc_id", borrowed)
    handed = base.join(need, F.col("key") == F.col("next_key")).select(
        "owner", "doc_id", F.substring(F.col("text"), F.lit(1), F.col("borrowed")).alias("head"), sketch(F.col("text"), k).alias("next_sketch")
    )
    rows = base.join(handed, F.col("key") == F.col("owner"))
    n = F.length("text")
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head")).alias("edited"),
        "text",
        "next_sketch",
    )
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _once(
        F.struct(sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("new"), F.col("next_sketch").alias("next")),
        lambda s: F.struct(
            fingerprint(s["own"]).alias("fingerprint"),
            fingerprint(s["new"]).alias("edited_fingerprint"),
            resemblance(s["own"], s["new"], k).alias("near_edited"),
            resemblance(s["own"], s["next"], k).alias("near_next"),
        ),
    ).alias("found"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "found.*")
