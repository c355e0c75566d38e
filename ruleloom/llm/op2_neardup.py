"""Near duplicates by MinHash with tensored banding.

Two collections of m small hashes (two minhashes each) are kept per text; every pair of one hash from either collection is
the key of a table, so 4m minhashes serve m * m tables. A pair of similarity s shares no table only if one collection shares
nothing at all, at most 2 * (1 - s^2)^m; m is set so that this is at most MISS at the threshold. A hash no other text has in
its place cannot meet anyone in any table of its row or column, so keys are formed only from hashes that are shared.

What shares a table is verified on full shingle sets, recomputed from the whole texts. Texts with equal sets (by a 128-bit
signature) are one class before any of this. First every member of a table meets its smallest id. Tables that still hold
several components go on: for their texts it is counted how many shingles no other of them has, and their shingles are marked
in a bit map; both bound what two texts can have in common. In the tables of one collection, members meet the pivots with
fewest shingles of their own, one, then PIVOTS, then all that are left, but only where the bound allows a link and the
components differ. So no link between components is lost, and in a large group of near copies few pairs are ever formed that
are no links.

Null texts, and texts without words, have an empty set and are linked with nothing. Texts with fewer words than a shingle
are one shingle; texts of any length are compared whole. Rows with a null id have a null component and are kept. Rows that
share an id are documents each, with sets of their own: if ids repeat, rows are numbered in the order of id and text, and
components are found among the numbers, so that the smallest number has the smallest id. An empty table gives an empty
result; columns other than id and text are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import Words, mix, pieces, shingles, utf8
from ruleloom.llm.components import components
from ruleloom.llm.tables import texts
from ruleloom.operators.indexing import global_index
from ruleloom.staging import stage, stage_observed

#: Chance that the tables miss a pair just at the threshold.
MISS = 1e-5
#: Minhashes in one small hash.
ROWS = 2
#: Pivots of a table in the second round.
PIVOTS = 16
#: Words of 64 bits in the bit map of a text.
MAP = 32

_U = np.uint64


def collection_size(percent: int) -> int:
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS))


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*utf8(column))
    return shingles(words, words.hashes(lower=True), width)


def sketch(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys): set size, set signature, and the small hashes of both collections in turn."""
    m = collection_size(percent)
    rng = np.random.default_rng(77)
    flips = rng.integers(0, 2**63, 2 * m * ROWS, dtype=_U)
    factors = rng.integers(0, 2**63, 2 * m * ROWS, dtype=_U) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, bounds = _sets(part.column("text"), width)
                size = np.diff(bounds)
                full = size > 0
                starts = bounds[:-1][full]
                keys = np.zeros((len(size), 2 * m), _U)
                signs = np.zeros((2, len(size)), _U)
                if len(starts):
                    with np.errstate(over="ignore"):
                        for k, salt in enumerate((11, 12)):
                            signs[k, full] = np.add.reduceat(mix(value, salt), starts)
                        for k in range(2 * m):
                            total = np.full(len(starts), k, _U)
                            for j in range(k * ROWS, (k + 1) * ROWS):
                                total = mix(total + np.minimum.reduceat((value ^ flips[j]) * factors[j], starts))
                            keys[full, k] = total
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), 2 * m)
                columns = [
                    part.column("doc_id"), pa.array(size, pa.int64()), pa.array(signs[0].view(np.int64)),
                    pa.array(signs[1].view(np.int64)), lists.cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def table_keys(classes: DataFrame, m: int) -> DataFrame:
    """(bucket, id) of every table entry that can meet another one."""
    sides = classes.select("id", F.posexplode("keys").alias("side", "key"))
    shared = sides.groupBy("side", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = sides.join(shared, ["side", "key"]).groupBy("id").agg(F.collect_list(F.struct("side", "key")).alias("live"))
    one = live.select("id", F.filter("live", lambda x: x["side"] >= m).alias("second"), F.explode(F.filter("live", lambda x: x["side"] < m)).alias("a"))
    both = one.select("id", "a", F.explode("second").alias("b"))
    return both.select(F.xxhash64("a.side", "b.side", "a.key", "b.key").alias("bucket"), "id")


def verify(pairs: DataFrame, candidates: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (u, v) of `pairs` with 100 * |intersection| >= percent * |union|, on the full sets of their texts.

    Both joins are inner equi-joins of shuffled sides: the pairs of a text that is in very many of them are split.
    """
    rows = pairs.select("u", "v")
    for side in ("v", "u"):
        rows = rows.join(candidates.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in pieces(batch, "text_u"):
                for part in pieces(half, "text_v"):
                    (a, at_a), (b, at_b) = _sets(part.column("text_u"), width), _sets(part.column("text_v"), width)
                    ok = np.zeros(part.num_rows, bool)
                    for i in range(part.num_rows):
                        one, two = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                        common = len(np.intersect1d(one, two, assume_unique=True))
                        ok[i] = 100 * common >= percent * (len(one) + len(two) - common) and common > 0
                    yield pa.RecordBatch.from_arrays([part.column("u").filter(ok), part.column("v").filter(ok)], ["u", "v"])

    return rows.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _apart(members: DataFrame) -> DataFrame:
    """Members of the tables that hold more than one component."""
    span = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return members.join(span.select("bucket"), "bucket")


def outlines(members: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(id, size, own, bits) of the texts in `members`, from which follows how much any two of them can have in common.

    size: shingles; own: those that no other text in `members` has; bits: a bit map of the shingles' hashes.
    """
    chosen = candidates.join(members.select("id").distinct(), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, bounds = _sets(part.column("text"), width)
                size = np.diff(bounds)
                row = np.repeat(np.arange(len(size)), size)
                flags = np.zeros((len(size), 64 * MAP), bool)
                flags[row, (value >> _U(40)) % _U(64 * MAP)] = True
                maps = np.packbits(flags, axis=1).view(np.int64)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(maps.ravel()), MAP).cast(pa.list_(pa.int64()))
                none = pa.nulls(len(row), pa.list_(pa.int64()))
                # One row for each text, then one for each of its shingles.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[row]])),
                        pa.array(np.concatenate([np.zeros(len(size), np.int64), value.view(np.int64)])),
                        pa.array(np.concatenate([size, np.zeros(len(row), np.int64)])),
                        pa.concat_arrays([lists, none]),
                    ],
                    ["id", "shingle", "size", "bits"],
                )

    rows = chosen.select("id", "text").mapInArrow(run, "id long, shingle long, size long, bits array<long>")
    rows = stage(rows, "shingles")
    found = rows.where("size = 0").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    own = found.groupBy("id").agg(F.count("*").alias("own"))
    return rows.where("size > 0").join(own, "id", "left").select("id", "size", F.coalesce("own", F.lit(0)).alias("own"), "bits")


def _can_link(percent: int) -> Column:
    """Whether two texts may be alike enough: no shingle of either's own is common, and each bit of difference between the
    maps is a shingle that only one of them has."""
    apart = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(MAP)), F.lit(0))
    both = F.col("size") + F.col("size_b")

    def enough(common: Column) -> Column:
        return 100 * common >= percent * (both - common)

    # The cheap bound first: the maps are compared where it allows a link only.
    return enough(F.least(F.col("size") - F.col("own"), F.col("size_b") - F.col("own_b"))) & enough(F.floor((both - apart) / 2))


def linked(classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame | None:
    """(id, component) of the classes that have a link, or None if nothing has."""
    entries = table_keys(classes, collection_size(percent)).withColumn("component", F.col("id"))
    tables, seen = stage_observed(_apart(entries), "tables")
    if not seen["rows"]:
        return None
    ids = tables.select(F.col("id").alias("doc_id")).distinct()
    candidates = docs.join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    candidates = stage(candidates, "candidates")
    # Every member with the smallest id of its table.
    lead = tables.groupBy("bucket").agg(F.min("id").alias("pivot"))
    links = _links(tables.join(lead, "bucket").where("id != pivot").select("id", F.col("pivot").alias("id_b")), candidates, percent, width)
    labels = stage(components(links), "labels")
    rest, seen = stage_observed(_apart(_named(tables.select("bucket", "id"), labels)), "tables")
    if not seen["rows"]:
        return labels
    # The texts still apart, by the hashes of one collection alone: a tenth of the tables, and a bound instead of a second hash.
    known = outlines(rest, candidates, width).where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
    known = classes.join(known, "id").select("id", "size", "own", "bits", F.posexplode(F.slice("keys", 1, collection_size(percent))).alias("side", "key"))
    rest = known.select(F.xxhash64("side", "key").alias("bucket"), "id", "size", "own", "bits")
    for pivots in (1, PIVOTS, None):
        rest, seen = stage_observed(_apart(_named(rest, labels)), "tables")
        if not seen["rows"]:
            break
        other = _pivots(rest, pivots)
        other = other.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "size", "own", "bits")])
        fresh = F.col("component") != F.col("component_b")
        if pivots is None:
            fresh = fresh & (F.col("id") < F.col("id_b"))  # both sides are the same members
        met = rest.join(other, "bucket").where(fresh & _can_link(percent))
        links = links.union(_links(met.select("id", "id_b"), candidates, percent, width))
        labels = stage(components(links), "labels")
        if pivots is not None:
            gone = other.select("bucket", F.col("id_b").alias("id"))
            rest = rest.drop("component").join(gone, ["bucket", "id"], "left_anti")
    return labels


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    joined = members.join(labels, "id", "left")
    return joined.withColumn("component", F.coalesce("component", "id"))


def _pivots(members: DataFrame, number: int | None) -> DataFrame:
    """`number` members of each table at most, those with fewest shingles of their own in each part; all if None."""
    if number is None:
        return members
    part = F.pmod(F.xxhash64("id"), F.lit(number)).alias("part")
    least = members.groupBy("bucket", part).agg(F.min(F.struct("own", "id", "component", "size", "bits")).alias("p"))
    return least.select("bucket", "p.id", "p.component", "p.size", "p.own", "p.bits")


def _links(met: DataFrame, candidates: DataFrame, percent: int, width: int) -> DataFrame:
    pairs = met.select(F.least("id", "id_b").alias("u"), F.greatest("id", "id_b").alias("v")).distinct()
    return stage(verify(stage(pairs, "pairs"), candidates, percent, width), "links")


def _repeats(rows: DataFrame) -> bool:
    """Whether rows share an id."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `place`, their number in the order of id and text; null for rows without id."""
    named = global_index(rows.where("doc_id is not null"), [F.asc("doc_id"), F.asc("text")], "place")
    return named.unionByName(rows.where("doc_id is null").withColumn("place", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept: it has the smallest id of its component."""
    rows = texts(docs)
    if not _repeats(rows):
        return _classified(rows, percent, width)
    numbered = stage(_numbered(rows), "numbered")
    found = stage(_classified(numbered.select(F.col("place").alias("doc_id"), "text"), percent, width), "near-duplicates")
    ids = numbered.where("place is not null").select("place", "doc_id")
    mine = found.withColumnRenamed("doc_id", "place").join(ids, "place", "left")
    heads = ids.select(F.col("place").alias("component_id"), F.col("doc_id").alias("head"))
    mine = mine.join(heads, "component_id", "left").select("doc_id", "n_shingles", F.col("head").alias("component_id"))
    return mine.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _headed(rows: DataFrame) -> DataFrame:
    """`rows` with `head`, the smallest id among those with the same set.

    Sets of more rows than a shuffle partition's mean are fewer than the partitions: they are joined by broadcast, so that no
    task gets all copies of a set.
    """
    key = ["s1", "s2", "n_shingles"]
    heads = rows.groupBy(*key).agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    heads, seen = stage_observed(heads, "heads", all=F.sum("copies"))
    mean = (seen["all"] or 0) / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = F.col("copies") > max(mean, 1)
    known = rows.join(F.broadcast(heads.where(large).drop("copies")), key, "left")
    rest = known.where("head is null").drop("head").join(heads.where(~large).drop("copies"), key)
    return known.where("head is not null").unionByName(rest)


def _classified(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """`near_duplicates` of (doc_id, text) rows of which no two share an id."""
    rows = stage(sketch(docs, percent, width), "sketch")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    members = stage(_headed(rows.where(usable)).select(
        "doc_id", "n_shingles", "head", F.when(F.col("doc_id") == F.col("head"), F.col("keys")).alias("keys")), "members")
    classes = members.where("doc_id = head").select(F.col("doc_id").alias("id"), "keys")
    labels = linked(classes, docs, percent, width)
    members = members.drop("keys")
    if labels is not None:
        members = members.join(labels.withColumnRenamed("id", "head"), "head", "left")
    else:
        members = members.withColumn("component", F.col("head"))
    members = members.select("doc_id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    alone = rows.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id") -> DataFrame:
    """The documents, all columns, without those that are not the first of their component.

    Rows without id stay. Of rows that share an id and are no near duplicates all stay; of a repeated row one does.
    """
    rows = texts(docs, key=key)
    if not _repeats(rows):
        result = stage(_classified(rows, percent, width), "near-duplicates")
        gone = result.where("not kept").select(F.col("doc_id").alias(key))
        return docs.join(gone, key, "left_anti")
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("doc"))
    numbered = stage(_numbered(whole), "numbered")
    result = stage(_classified(numbered.select(F.col("place").alias("doc_id"), "text"), percent, width), "near-duplicates")
    gone = result.where("not kept").select(F.col("doc_id").alias("place"))
    return numbered.join(gone, "place", "left_anti").select("doc.*")
