"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Equal vectors are one node, which carries the k + 1 smallest ids of its rows: no other row of it can be among the k nearest of
anyone, since ties go to the smaller id. Nodes are dealt to shards by hash, so that every shard is a fair sample of all. The
index is a table of nodes with their place, level and neighbours, one flat array of links for all layers; it is built once and
can be kept. A search sends every different query vector to every shard in turn, block by block, finds the nodes nearest in
the shard's graph, computes their cosine in double precision on the original vectors, and merges the shards by score and id.

Rows without id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors of
different lengths never meet. A row that repeats id and vector counts once; rows that share an id but not the vector are
rows each, and only the very row is left out of its own answer. Ties go to the smaller id. Fewer than k candidates give fewer
rows, an empty table gives an empty one, and other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.llm import hnsw
from ruleloom.staging import stage, stage_observed

#: Neighbours of a node in upper layers, twice as many in the lowest; nodes held while a graph is built, and searched.
LINKS, BUILD, SEARCH = 24, 100, 128
#: The number of shards is the root of the number of nodes over SPREAD, and so many that none has more than SHARD_BYTES.
SPREAD, SHARD_BYTES = 32, 2**28
#: Tasks that one hot vector's ids are dealt to before they meet.
SALTS = 64

_NODE = "shard int, dim int, a long, b long, ids array<long>, v array<double>"
_INDEX = f"{_NODE}, place int, level int, links array<int>"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, a, b, v) of the rows that take part; a and b identify the vector."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # A null component makes the test null, which filters out as false does.
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zero
    return rows.select("vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"), "v")


def _least(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task before it shuffles."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """(a, b, ids, v) of the different vectors of `usable` rows without repeats; ids: the k + 1 smallest."""
    ids = rows.select("a", "b", "vec_id", F.pmod("vec_id", F.lit(SALTS)).alias("_salt"))
    ids = _least(_least(ids, ["a", "b", "_salt"], [F.col("vec_id")], k + 1), ["a", "b"], [F.col("vec_id")], k + 1)
    ids = ids.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    heads = ids.withColumn("vec_id", F.get("ids", F.lit(0)))
    return rows.join(heads, ["a", "b", "vec_id"]).select("a", "b", "ids", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) runs of equal keys of a sorted stream; a run may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield tuple(int(v[start]) for v in values), batch.slice(start, end - start)


def _built(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The nodes of one shard with their places, levels and links."""
    table = pa.Table.from_batches(parts).combine_chunks()
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    # A level is drawn from the node's hash: a task that runs again builds the same graph.
    drawn = ((b.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    level = np.floor(-np.log(drawn) / math.log(LINKS)).astype(np.int64)
    order = np.lexsort((b, a, -level))
    table, level = table.take(pa.array(order)), level[order]
    links = hnsw.build(_unit(_matrix(table["v"])), level, LINKS, BUILD)
    flat = [np.concatenate([layer[i] for layer in links[: level[i] + 1]]) for i in range(len(level))]
    table = table.append_column("place", pa.array(np.arange(len(level)), pa.int32())).append_column("level", pa.array(level, pa.int32()))
    return table.append_column("links", pa.array(flat, pa.list_(pa.int32()))).to_batches()[0]


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def build_index(vertices: DataFrame, bytes_: int) -> DataFrame:
    """The index table (shard, dim, a, b, ids, v, place, level, links) of (a, b, ids, v) nodes; bytes_: of all their vectors."""
    counted, seen = stage_observed(vertices, "nodes")
    shards = max(1, math.ceil(math.sqrt(seen["rows"]) / SPREAD), math.ceil(bytes_ / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for key, part in _groups(batches, ["shard", "dim"]):
            if key != now and held:
                yield _built(held)
                held = []
            now = key
            held.append(part)
        if held:
            yield _built(held)

    dealt = counted.select(
        F.pmod(F.shiftright("a", 20), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "a", "b", "ids", "v"
    )
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "dim")
    return stage(dealt.mapInArrow(run, _INDEX), "graph")


def _graph(parts: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, pa.Table]:
    """(links by layer, unit vectors, rows in their places) of one shard of the index."""
    table = pa.Table.from_batches(parts).combine_chunks()
    table = table.take(pa.array(np.argsort(table["place"].to_numpy())))
    level = table["level"].to_numpy()
    column = table["links"].combine_chunks()
    flat, begin = column.values.to_numpy(), column.offsets.to_numpy()
    layers = []
    for at in range(int(level[0]) + 1):
        count, width, skip = int((level >= at).sum()), LINKS if at else 2 * LINKS, (at + 1) * LINKS if at else 0
        layers.append(np.ascontiguousarray(flat[begin[:count, None] + skip + np.arange(width)]))
    return layers, _unit(_matrix(table["v"])), table


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine in double precision of each row of `x` (queries, nodes, dim) with its query; no negative zero."""
    return (x * q[:, None, :]).sum(2) / (np.sqrt((x * x).sum(2)) * np.sqrt((q * q).sum(1))[:, None]) + 0.0


def search(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(qa, qb, ids, score): for each vector (a, b, v) of `queries`, the `keep` nearest nodes found in each shard of the index."""
    shards = index.agg(F.max("shard")).first()[0] or 0
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("shard"), F.size("v").alias("dim"), "a", "b",
        F.lit(None).cast("array<long>").alias("ids"), "v", F.lit(None).cast("int").alias("place"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<int>").alias("links"), F.lit(1).alias("asks"),
    )
    together = index.withColumn("asks", F.lit(0)).unionByName(asked)

    def answer(graph, part: pa.RecordBatch) -> pa.RecordBatch:
        layers, x, table = graph
        q = _matrix(part.column("v"))
        found, sim = hnsw.nearest(layers, x, _unit(q), SEARCH)
        original = _matrix(table["v"])
        # More than asked for: single precision may swap near ties. Equal scores go to the smaller id.
        found = found[:, : 4 * keep]
        score = np.where(found >= 0, _cosines(original[found], q), -np.inf)
        ids = table["ids"].chunk(0)
        least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        best = np.lexsort((least[found], -score), axis=1)[:, :keep]
        node, value = np.take_along_axis(found, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
        at = np.repeat(np.arange(len(q)), best.shape[1])[node >= 0]
        value, node = value[node >= 0], node[node >= 0]
        columns = [part.column("a").take(pa.array(at)), part.column("b").take(pa.array(at)), table["a"].take(pa.array(node)).combine_chunks(),
                   table["b"].take(pa.array(node)).combine_chunks(), table["ids"].take(pa.array(node)).combine_chunks(), pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, ["qa", "qb", "a", "b", "ids", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, graph = None, [], None
        for (shard, dim, asks), part in _groups(batches, ["shard", "dim", "asks"]):
            if (shard, dim) != now:
                now, held, graph = (shard, dim), [], None
            if not asks:
                held.append(part)
            elif held or graph:
                graph, held = graph or _graph(held), []
                step = hnsw.batch_size(dim)
                for at in range(0, part.num_rows, step):
                    yield answer(graph, part.slice(at, step))

    dealt = together.repartitionByRange(shards + 1, "shard").sortWithinPartitions("shard", "dim", "asks")
    return dealt.mapInArrow(run, "qa long, qb long, a long, b long, ids array<long>, score double")


def neighbours(
    vectors: DataFrame, k: int = 5, queries: Column | str | None = None, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query row, by cosine.

    queries: a condition on `vec_id` that says which rows ask; all if None.
    """
    rows = usable(vectors, key, vector)
    rows = rows.groupBy("a", "b", "vec_id").agg(F.first("v").alias("v"))
    rows, seen = stage_observed(rows, "vectors", bytes=F.sum(F.size("v") * 4))
    index = build_index(nodes(rows, k), seen["bytes"] or 0)
    asking = rows if queries is None else rows.where(queries)
    different = _least(asking.select("a", "b", "v"), ["a", "b"], [F.col("a")], 1)
    met = stage(search(index, different, k + 1), "met")
    single = met.select("qa", "qb", "a", "b", F.explode("ids").alias("vec_id"), "score")
    best = _least(single, ["qa", "qb"], [F.desc("score"), F.asc("vec_id"), F.asc("a")], k + 1)
    near = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "a", "b", "score"))).alias("near")
    best = best.groupBy("qa", "qb").agg(near)
    asking = asking.select(F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"))

    def other(x: Column) -> Column:
        return ~((x["vec_id"] == F.col("query_id")) & (x["a"] == F.col("qa")) & (x["b"] == F.col("qb")))

    answers = asking.join(best, ["qa", "qb"]).select("query_id", F.posexplode(F.slice(F.filter("near", other), 1, k)).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
