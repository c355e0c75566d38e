"""The corpus pipeline: documents that pass quality rules and a quality classifier, one of each group of near duplicates,
packed into training sequences. Every stage reads what the stage before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import op2_neardup, op3_rules, op5_packing, op10_discriminant
from ruleloom.llm.bpe import file_of
from ruleloom.llm.tables import table
from ruleloom.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept by the base rules and the calibrated n-gram model, which learns from the labelled documents."""
    model = op3_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op3_rules.accepted(docs, model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant predicts good; it learns from all labelled documents, also those rejected before.

    The statistics are staged, so that no task runs two Python workers, one for them and one for their moments: an executor
    keeps its workers, each as large as it ever was, through all later stages.
    """
    known = stage(op10_discriminant.features(table(spark, sf_dir, "documents")), "statistics")
    return op10_discriminant.accepted(docs, op10_discriminant.learn(known, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return op2_neardup.deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return op5_packing.pack(docs, file_of("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Tokens, hashed n-grams and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
