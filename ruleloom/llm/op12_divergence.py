"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Terms are counted where they are read, in Arrow batches; what is shuffled has a 64-bit digest in a term's place, in fixed-width
arrays: one row for each batch of documents and bucket of digests. The strings go a way of their own, one for each different term
of a batch, and only the smallest and the largest string of each kept digest are looked at. Where these two differ the digest
stands for several terms; the terms of those digests, and of no others, are counted again with their strings and told apart by a
number beside the digest. Text is joined back for the rows that are returned only.

Smoothed shares are whole numbers of billionths, all arithmetic is on longs and decimals, so the result does not depend on
the order of summation. The sum over all kept terms of a language needs no table of every term in every source: terms that
a source lacks have one and the same share there, so a pair of sources is its two histograms of counts plus the terms both have.

Null text, lang and source are empty strings. A group without terms, or a language without kept terms, has its rows in part
`pair` (value 0 if no term is kept); an only source of a language has none. Repeated rows are documents each, whatever their
ids; texts of any length are counted whole; ties in value go to the smaller item; an empty table gives an empty one. Columns
other than text, lang and source are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.llm.batches import LOWER, Words, pieces, strings, utf8
from ruleloom.operators.indexing import global_index
from ruleloom.staging import stage, stage_observed

#: A kept term stands in so many documents of its language.
DOCUMENTS = 3
#: Ranks of part `term` that are returned.
RANKS = 200
#: Bits of a digest.
BITS = 64
#: Bytes of text counted together.
CHUNK = 8_000_000
#: Bytes of text whose digests meet in one bucket; a bucket is reduced in one task. Buckets there are at least.
BUCKET, LEAST_BUCKETS = 2**24, 32

#: What stands in no term, by byte: `[\x00-\x40\x5B-\x60\x7B-\x7F]`.
GAP = np.zeros(256, bool)
GAP[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_GROUP = ["lang", "source"]
_TERM = ["digest", "twin"]


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *_GROUP)])


class _Counted:
    """The terms of a batch, and for each term and group of documents that has it: occurrences and documents."""

    def __init__(self, part: pa.RecordBatch, bits: int):
        offsets, data = utf8(part.column("text"))
        words = Words(offsets, LOWER[data], GAP)
        terms = strings(words).dictionary_encode()
        self.terms, size = terms.dictionary, len(terms.dictionary)
        mask = (1 << bits) - 1
        self.digests = np.array([xxhash.xxh64_intdigest(t.encode()) & mask for t in self.terms.to_pylist()], np.uint64)
        coded = [part.column(c).dictionary_encode() for c in _GROUP]
        codes = [c.indices.to_numpy().astype(np.int64) for c in coded]
        groups, of = np.unique(codes[0] * len(coded[1].dictionary) + codes[1], return_inverse=True)
        names = [groups // len(coded[1].dictionary), groups % len(coded[1].dictionary)]
        self.names = [c.dictionary.take(pa.array(at)) for c, at in zip(coded, names, strict=True)]
        pair, n = np.unique(words.doc * size + terms.indices.to_numpy(), return_counts=True)
        met, at = np.unique(of[pair // max(size, 1)] * size + pair % max(size, 1), return_inverse=True)
        self.group, self.term = met // max(size, 1), met % max(size, 1)
        self.n, self.df = np.bincount(at, weights=n).astype(np.int64), np.bincount(at)


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    offsets = pa.py_buffer(bounds * values.itemsize)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])
    return whole.cast(pa.binary())


_BLOCK = "bucket int, langs array<string>, sources array<string>, terms array<string>, digests binary, at binary, term binary, n binary, df binary"


def term_blocks(docs: DataFrame, buckets: int, bits: int = BITS) -> DataFrame:
    """The counts of each batch of documents, one row for each bucket of digests: names of the groups, terms and their digests, and
    for each term of a group the places of both, occurrences and documents, as arrays of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                c = _Counted(part, bits)
                bucket = (c.digests % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                own, first = np.unique(bucket[order], return_index=True)
                terms_at = np.append(first, len(order))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(first, np.diff(terms_at))
                of = np.searchsorted(own, bucket[c.term])
                # Of the groups, each row names those that it needs.
                needed, name = np.unique(of * len(c.names[0]) + c.group, return_inverse=True)
                names_at = np.searchsorted(needed, np.arange(len(own) + 1) * len(c.names[0]))
                rows = np.argsort(of, kind="stable")
                rows_at = np.searchsorted(of[rows], np.arange(len(own) + 1))
                name, named = name - names_at[of], pa.array(needed % max(len(c.names[0]), 1))
                lists = [pa.ListArray.from_arrays(pa.array(names_at, pa.int32()), x.take(named)) for x in c.names]
                texts = c.terms.take(pa.array(order)).cast(pa.string())
                lists.append(pa.ListArray.from_arrays(pa.array(terms_at, pa.int32()), texts))
                wide = [_cut(x[rows].astype(np.int32), rows_at) for x in (name, place[c.term], c.n, c.df)]
                columns = [pa.array(own, pa.int32()), *lists, _cut(c.digests[order], terms_at), *wide]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "langs", "sources", "terms", "digests", "at", "term", "n", "df"])

    return _read(docs).mapInArrow(run, _BLOCK)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(np.concatenate([[True], new]))


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows in turn, number of values of each row) of a binary column."""
    values = np.frombuffer(b"".join(column.to_pylist()), kind)
    return values, np.array([len(x) for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize


def _kept(table: pa.Table) -> pa.Table:
    """The kept terms of one bucket: counts in each group (part 0), their strings (1), or digests of several strings (2)."""
    digests, of_row = _flat(table["digests"], np.int64)
    term, rows = _flat(table["term"], np.int32)
    at, n, df = (_flat(table[c], np.int32)[0] for c in ("at", "n", "df"))
    digest = digests[term + np.repeat(np.cumsum(of_row) - of_row, rows)]
    langs, sources = (table[c].combine_chunks() for c in ("langs", "sources"))
    named = np.diff(langs.offsets.to_numpy())
    name = at + np.repeat(np.cumsum(named) - named, rows)
    lang, source = (x.flatten().dictionary_encode() for x in (langs, sources))
    a, b = lang.indices.to_numpy()[name], source.indices.to_numpy()[name]
    order = np.lexsort((b, a, digest))
    digest, a, b, n, df = digest[order], a[order], b[order], n[order].astype(np.int64), df[order].astype(np.int64)
    first = _starts(digest, a, b)
    digest, a, b, n, df = digest[first], a[first], b[first], np.add.reduceat(n, first), np.add.reduceat(df, first)
    first = _starts(digest, a)
    size = np.diff(np.append(first, len(digest)))
    keep = np.repeat(np.add.reduceat(df, first) >= DOCUMENTS, size)
    n_lang = np.repeat(np.add.reduceat(n, first), size)
    digest, a, b, n, n_lang = digest[keep], a[keep], b[keep], n[keep], n_lang[keep]
    found = np.isin(digests, digest)
    texts = pa.table({"digest": digests[found], "term": table["terms"].combine_chunks().flatten().filter(pa.array(found))})
    texts = texts.sort_by([("digest", "ascending"), ("term", "ascending")])
    first = _starts(texts["digest"].to_numpy()) if len(texts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(texts)) - 1 if len(first) else first
    least, most = texts["term"].take(pa.array(first)).combine_chunks(), texts["term"].take(pa.array(last)).combine_chunks()
    named = texts["digest"].to_numpy()[first]
    shared = np.array(pc.not_equal(least, most).to_pylist(), bool)
    whole = ~np.isin(digest, named[shared])
    sizes = [int(whole.sum()), int((~shared).sum()), int(shared.sum())]
    none = [pa.nulls(k, t) for k, t in ((sizes[1] + sizes[2], pa.string()), (sizes[1] + sizes[2], pa.int64()), (sizes[0], pa.string()))]
    return pa.table(
        {
            "part": pa.array(np.repeat([0, 1, 2], sizes), pa.int32()),
            "lang": pa.concat_arrays([lang.dictionary.take(pa.array(a[whole])), none[0]]),
            "source": pa.concat_arrays([source.dictionary.take(pa.array(b[whole])), none[0]]),
            "digest": pa.array(np.concatenate([digest[whole], named[~shared], named[shared]])),
            "n": pa.concat_arrays([pa.array(n[whole]), none[1]]),
            "n_lang": pa.concat_arrays([pa.array(n_lang[whole]), none[1]]),
            "term": pa.concat_arrays([none[2], least.filter(pa.array(~shared)), least.filter(pa.array(shared))]),
        }
    )


def spelled_counts(docs: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, term, n, df) of the terms that have one of the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                c = _Counted(part, bits)
                names, term = [x.take(pa.array(c.group)) for x in c.names], pa.array(c.term)
                columns = [*names, pa.array(c.digests.view(np.int64)).take(term), c.terms.take(term).cast(pa.string()), pa.array(c.n), pa.array(c.df)]
                yield pa.RecordBatch.from_arrays(columns, [*_GROUP, "digest", "term", "n", "df"])

    rows = _read(docs).mapInArrow(run, "lang string, source string, digest long, term string, n long, df long")
    rows = rows.join(digests, "digest", "left_semi")
    return rows.groupBy(*_GROUP, "digest", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_counts(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, digest, twin, n, n_lang), (digest, twin, term)) of the terms that enough documents of a language have.

    `twin` tells the terms of one digest apart; it is 0 where a digest has one term. A digest that is not kept stands for no
    term that is, so strings are compared for kept ones only.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = term_blocks(docs, max(LEAST_BUCKETS, -(-size // BUCKET)), bits)
    kind = "part int, lang string, source string, digest long, n long, n_lang long, term string"
    found, seen = stage_observed(blocks.groupBy("bucket").applyInArrow(_kept, kind), "kept", shared=F.sum((F.col("part") == 2).cast("int")))
    held = found.where("part = 0").select(*_GROUP, "digest", F.lit(0).alias("twin"), "n", "n_lang")
    names = found.where("part = 1").select("digest", F.lit(0).alias("twin"), "term")
    if not seen["shared"]:
        return held, names
    again = stage(spelled_counts(docs, found.where("part = 2").select("digest"), bits), "spelled")
    told = again.select("digest", "term").distinct()
    told = told.withColumn("twin", F.row_number().over(W.partitionBy("digest").orderBy("term")))
    of_lang = again.groupBy("lang", "digest", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= DOCUMENTS)
    split = again.drop("df").join(of_lang.drop("df"), ["lang", "digest", "term"]).join(told, ["digest", "term"])
    return held.unionByName(split.drop("term")), names.unionByName(told)


def _share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share in billionths: 1 + floor(10^9 * (n + 1) / (total + kept)), exact at any size."""
    size = "decimal(19,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast(size) + 1), total.cast(size) + kept.cast(size))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(20,0)"))


def groups_of(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, g, l, total, kept, terms, none, lang_total) of every group that occurs.

    g and l number group and language; none: the share of a term that the group lacks.
    """
    groups = global_index(_read(docs).select(*_GROUP).distinct(), [F.asc(c) for c in _GROUP], "g")
    own = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    # A term's count in the language stands with each of its sources: it is taken once.
    langs = held.groupBy("lang", *_TERM).agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    known = groups.join(own, _GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total", "kept"])
    known = known.join(groups.groupBy("lang").agg(F.min("g").alias("l")), "lang")
    return known.withColumn("none", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))))


def pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, other, value): the distance of every group from each other source of its language, over all kept terms.

    held: (g, l, digest, twin, p, none); groups: (g, l, kept, terms, none).
    """
    f, zero = _distance, F.lit(0).cast("decimal(20,0)")
    one, two = groups.alias("a"), groups.alias("b")
    both = one.join(two, F.col("a.l") == F.col("b.l")).where("a.g != b.g")
    lacking = (F.col("a.kept") - F.col("a.terms") - F.col("b.terms")).cast("decimal(19,0)") * f(F.col("a.none"), F.col("b.none"))
    base = both.select("a.g", F.col("b.g").alias("other"), F.coalesce(lacking.cast("decimal(38,0)"), zero).alias("value"))

    histogram = held.groupBy("l", "g", "p", "none").agg(F.count("*").alias("h"))
    met = histogram.alias("a").join(two, F.col("a.l") == F.col("b.l")).where("a.g != b.g")
    h = F.col("a.h").cast("decimal(19,0)")
    sides = met.groupBy(F.col("a.g").alias("x"), F.col("b.g").alias("y"))
    sides = sides.agg(F.sum(h * f(F.col("a.p"), F.col("b.none"))).alias("to"), F.sum(h * f(F.col("b.none"), F.col("a.p"))).alias("from"))

    # Terms that both have: what they add to the shares that the histograms took for lacking.
    one, two = held.alias("a"), held.alias("b")
    met = one.join(two, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("l", *_TERM)]).where("a.g < b.g")
    p, q, p0, q0 = F.col("a.p"), F.col("b.p"), F.col("a.none"), F.col("b.none")
    common = met.groupBy(F.col("a.g").alias("x"), F.col("b.g").alias("y")).agg(
        _exact_sum(f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("to"),
        _exact_sum(f(q, p) - f(q0, p) - f(q, p0) + f(q0, p0)).alias("from"),
    )
    turned = [(F.col("x"), F.col("y"), F.col("to")), (F.col("y"), F.col("x"), F.col("from"))]
    two_ways = F.explode(F.array(*[F.struct(a.alias("g"), b.alias("other"), v.cast("decimal(38,0)").alias("value")) for a, b, v in turned]))
    sums = sides.unionByName(common).select(two_ways.alias("r")).select("r.*")
    return base.unionByName(sums).groupBy("g", "other").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources and of the terms that each group has more of."""
    held, names = kept_counts(docs, bits)
    groups = stage(groups_of(docs, held), "groups")
    named = groups.select("g", *_GROUP)
    p = _share(F.col("n"), F.col("total"), F.col("kept"))
    known = held.join(groups, _GROUP).withColumn("p", p)
    value = pairs(known.select("g", "l", *_TERM, "p", "none"), groups.select("g", "l", "kept", "terms", "none"))
    value = value.join(named, "g").join(named.select(F.col("g").alias("other"), F.col("source").alias("item")), "other")
    order = W.partitionBy("g").orderBy(F.desc("value"), F.asc("item"))
    pair = value.select(*_GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    q = _share(F.col("n_lang"), F.col("lang_total"), F.col("kept"))
    more = known.withColumn("q", q).where("p > q").select("g", *_TERM, _distance(F.col("p"), F.col("q")).alias("value"))
    # All that tie at the last rank, then their strings, which decide between them.
    leading = F.rank().over(W.partitionBy("g").orderBy(F.desc("value")))
    more = more.withColumn("rank", leading).where(F.col("rank") <= RANKS).drop("rank").join(names, _TERM)
    more = more.withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    return pair.unionByName(more.join(named, "g").select(*_GROUP, F.lit("term").alias("part"), "item", "value", "rank"))


#: The same rows, over the table of every kept term in every group.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), found AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM found GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL HAVING sum(df) >= 3
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS n_lang
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT d.lang, d.source, d.term, d.n,
    1 + (1000000000 * (d.n + 1)) // (sum(d.n) OVER (PARTITION BY d.lang, d.source) + l.v) AS p,
    1 + (1000000000 * (d.n_lang + 1)) // (l.total + l.v) AS q
  FROM dense d JOIN langs l USING (lang)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM all_pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200
"""
