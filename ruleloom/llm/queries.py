"""The named queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import (
    op1_chat,
    op2_neardup,
    op3_rules,
    op4_tokens,
    op5_packing,
    op6_licenses,
    op7_pages,
    op8_fingerprints,
    op9_counts,
    op10_discriminant,
    op11_neighbours,
    op12_divergence,
    op13_spelling,
)
from ruleloom.llm.bpe import file_of
from ruleloom.llm.tables import table


def op1_chat_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Turns recovered from raw transcripts of all conversations, whose speakers are spelled in several ways or missing."""
    return op1_chat.recover(op1_chat.as_transcript(table(spark, folder, "conversations")))


def op2_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return op2_neardup.near_duplicates(table(spark, folder, "documents"), percent=85)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return op3_rules.quality_rules(docs, docs, table(spark, folder, "labels"))


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return op4_tokens.round_trip(table(spark, folder, "documents"), file_of("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return op5_packing.pack(table(spark, folder, "documents"), file_of("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return op6_licenses.scan(table(spark, folder, "documents"))


def op7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return op7_pages.extract(table(spark, folder, "pages"))


def op8_bottom_k_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return op8_fingerprints.edited(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return op9_counts.count_tokens(table(spark, folder, "documents"), file_of("byte_bpe_50k.json"))


def op10_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return op10_discriminant.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return op11_neighbours.neighbours(table(spark, folder, "embeddings"), 5, "vec_id % 50 = 0")


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return op12_divergence.audit(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return op13_spelling.variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_roles,
        op2_minhash_neardup,
        op3_quality_rules,
        op4_bpe_round_trip,
        op5_best_fit_packing,
        op6_license_scan,
        op7_page_text,
        op8_bottom_k_fingerprints,
        op9_token_counts,
        op10_quality_discriminant,
        op11_vector_neighbours,
        op12_source_divergence,
        op13_spelling_variants,
    )
}

#: DuckDB SQL for the rows of queries that SQL can express.
ORACLES: dict[str, str] = {"op12_source_divergence": op12_divergence.SQL}
