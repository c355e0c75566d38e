"""Transactions from warehouse tables: how relational records become item sets with a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.sources.text import equal_width, item_array
from ruleloom.staging import spread, stage


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_facts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The needed columns of a large table, over all cores even if it comes in one file."""
    return spread(load(spark, folder, name).select(*columns))


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    "l_linestatus", "l_shipdate",
)


def _line_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with its part's type. The line's key columns together identify it."""
    lines = load_facts(spark, folder, "lineitem", *LINE_COLUMNS).withColumnRenamed("l_partkey", "p_partkey")
    parts = load(spark, folder, "part").select("p_partkey", "p_type")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "p_partkey", "l_suppkey", cents)
    return lines.join(parts, "p_partkey").select(
        key.alias("rec_id"),
        "l_linestatus",
        "p_type",
        equal_width(F.col("l_quantity"), 10).alias("quantity_bin"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount_pct"),
        F.month("l_shipdate").alias("ship_month"),
        "l_returnflag",
    )


def line_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines: five categorical items, class = return flag (three classes)."""
    facts = _line_facts(spark, folder)
    items = {
        "st": F.col("l_linestatus"),
        "ty": F.col("p_type"),
        "q": F.col("quantity_bin"),
        "d": F.col("discount_pct"),
        "m": F.col("ship_month"),
    }
    return facts.select("rec_id", item_array(items, complete=True).alias("items"), F.col("l_returnflag").alias("label"))


def _with_header(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines after a bar line and a blank line. They are staged: the look at the first line and each later pass would join anew."""
    extra = spark.createDataFrame([("header", "|line records"), ("blank", "")], "rec_id string, value string")
    return extra.coalesce(1).unionByName(stage(lines, "text-lines"))


def line_text(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as comma-separated text (rec_id, value), headed by a bar line, with a blank line."""
    facts = _line_facts(spark, folder)
    value = F.concat_ws(
        ",", "l_linestatus", "p_type", "quantity_bin", "discount_pct", "ship_month", "l_returnflag"
    )
    return _with_header(spark, facts.select("rec_id", value.alias("value")))


def ragged_text(spark: SparkSession, folder: str) -> DataFrame:
    """Like `line_text`, with empty fields inside and at the end of lines."""
    facts = _line_facts(spark, folder)
    value = F.concat_ws(
        ",",
        "l_linestatus",
        F.when(F.col("discount_pct") > 5, "").otherwise(F.col("p_type")),
        F.when(F.col("quantity_bin") > 2, "").otherwise(F.col("quantity_bin").cast("string")),
        F.when(F.col("ship_month") > 6, "").otherwise(F.col("ship_month").cast("string")),
    )
    return _with_header(spark, facts.select("rec_id", value.alias("value")))


def document_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: language, source and shape of the text, class = quality (0 or 1)."""
    documents = load_facts(spark, folder, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labels = load(spark, folder, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    text = F.col("text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    items = {
        "lang": F.col("lang"),
        "src": F.col("source"),
        "len": F.length(F.bin(F.col("n_chars") + 1)) - 1,
        "nl": F.length(F.bin(breaks + 1)) - 1,
        "at": F.when(F.contains(text, F.lit("@")), 1).otherwise(0),
        "http": F.when(F.contains(text, F.lit("http")), 1).otherwise(0),
    }
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("rec_id"), item_array(items).alias("items"), "label"
    )


def order_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as baskets of the brands bought, class = order status (three classes)."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    lines = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")
    )
    parts = load(spark, folder, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, "p_partkey")
        .groupBy("o_orderkey")
        .agg(F.array_sort(F.collect_set("p_brand")).alias("items"))
        .join(orders, "o_orderkey")
        .select(F.col("o_orderkey").alias("rec_id"), "items", F.col("o_orderstatus").alias("label"))
    )


def weekly_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Users' weeks as baskets of event types, class = whether the user bought something that week."""
    events = load(spark, folder, "events").select(
        F.concat_ws(":", "user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("rec_id"),
        "event_type",
    )
    bought = F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("bigint")
    others = F.collect_set(F.when(F.col("event_type") != "purchase", F.col("event_type")))
    return events.groupBy("rec_id").agg(F.array_sort(others).alias("items"), bought.alias("label"))
