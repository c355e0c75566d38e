"""Connected components of a link table, by alternating large-star and small-star steps on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.staging import stage_observed


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `links` (u, v).

    Each step replaces links by links to a smaller neighbour and keeps the components; it ends when a step moves nothing: then
    every component is a star around its smallest id. A node's minimum is aggregated before it is joined back, and the join splits hot nodes.
    """
    edges = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).where("x != y")
    moved = 1
    while moved:
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select("m", F.col("y").alias("x"), (F.col("m") < F.col("x")).alias("moved"))
        # A node whose larger neighbours are linked past it stands inside a chain.
        large, seen = stage_observed(large.select("x", F.col("m").alias("y"), "moved"), "large-star", moved=F.sum(F.col("moved").cast("int")))
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select("x", "y", "m").where("x != m")
        small = small.select("x", F.col("m").alias("y"), F.lit(0).alias("other")).union(
            small.where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"), F.lit(1).alias("other"))
        )
        edges, split = stage_observed(small.groupBy("x", "y").agg(F.max("other").alias("other")), "small-star", moved=F.sum("other"))
        moved = (seen["moved"] or 0) + (split["moved"] or 0)
    roots = edges.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    return edges.select(F.col("x").alias("id"), F.col("y").alias("component")).union(roots)
