"""Labelled rows: one class for each document, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Rows whose labels no model may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classes(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label int) of the documents that may be learned from; null and contradicting labels say nothing."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    one = one.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return one.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")


def sample(rows: DataFrame, each: int) -> DataFrame:
    """At most `each` rows of either class, those with the smallest hash of their id."""
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    return parts[0].union(parts[1])
