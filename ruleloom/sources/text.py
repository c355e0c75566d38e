"""Text records in, dictionary-encoded transactions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.indexing import global_index

# Up to this many entries the dictionary travels to the records as one broadcast map, which is searched entry by entry; beyond
# it the cells are joined one by one. The result is the same.
DICTIONARY_MAP_LIMIT = 1000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def drop_header(lines: DataFrame) -> DataFrame:
    """If the first line starts with a bar, remove every line equal to it."""
    first = lines.select("value").first()
    if first is None or first["value"] is None or not first["value"].startswith("|"):
        return lines
    return lines.where(F.col("value") != F.lit(first["value"]))


def split_fields(value: Column, separator: str = ",") -> Column:
    """Fields of a line; empty fields at the end are dropped, nothing is trimmed."""
    quoted = f"\\Q{separator}\\E"
    return F.split(F.regexp_replace(value, f"(?:{quoted})+$", ""), quoted)


def parse_records(lines: DataFrame, separator: str = ",") -> DataFrame:
    """Header and blank lines dropped, the others split: adds `fields`, keeps all other columns."""
    kept = drop_header(lines).where(F.length("value") > 0)
    return kept.withColumn("fields", split_fields(F.col("value"), separator)).drop("value")


def build_dictionary(records: DataFrame) -> DataFrame:
    """Distinct (pos, value) numbered from 0, last column first, so that class ids are 0 .. numClasses-1.

    The numbering is a distributed sort; no partition ever sees more than its own range of values.
    """
    values = records.select(F.posexplode("fields").alias("pos", "value")).distinct()
    return global_index(values, [F.desc("pos"), F.asc("value")], "item_id")


def encode(
    records: DataFrame, dictionary: DataFrame, id_col: str = "rec_id", unknown: str = "error", map_limit: int = DICTIONARY_MAP_LIMIT
) -> DataFrame:
    """Records as (id, ids array<bigint>), the ids in column order; one row for each record, also where ids are equal or null.

    Cells are looked up in place in one broadcast map if the dictionary is proven small, else by a hash join. A value that is
    not in the dictionary is an error, or is left out with unknown="drop".
    """
    if unknown not in ("error", "drop"):
        raise ValueError(f"unknown must be error or drop, got {unknown!r}")
    if _fits_map(dictionary, map_limit):
        return _encode_by_map(records, dictionary, id_col, unknown)
    return _encode_by_join(records, dictionary, id_col, unknown)


def _unknown_value(pos: Column, value: Column) -> Column:
    cell = F.to_json(F.struct(pos.alias("pos"), value.alias("value")))
    return F.raise_error(F.concat(F.lit("value not in the dictionary: "), F.coalesce(cell, F.lit("null"))))


def _fits_map(dictionary: DataFrame, map_limit: int) -> bool:
    """Few entries, none repeated and none without a place, value or id: a map of them says the same as the table."""
    few = dictionary.limit(map_limit + 1)
    seen = few.agg(
        F.count("*").alias("rows"), F.count_distinct("pos", "value").alias("pairs"), F.count("item_id").alias("ids")
    ).first()
    return seen["rows"] <= map_limit and seen["rows"] == seen["pairs"] == seen["ids"]


def _encode_by_map(records: DataFrame, dictionary: DataFrame, id_col: str, unknown: str) -> DataFrame:
    """Look the cells up in a broadcast row with one map per place: no shuffle of the records."""
    ids_of = F.map_from_entries(F.collect_list(F.struct("value", F.col("item_id").cast("bigint")))).alias("ids_of")
    by_place = F.map_from_entries(F.collect_list(F.struct("pos", "ids_of"))).alias("_ids_of")
    maps = dictionary.groupBy("pos").agg(ids_of).agg(by_place)

    def found(value: Column, pos: Column) -> Column:
        item = F.try_element_at(F.try_element_at(F.col("_ids_of"), pos), value)
        return item if unknown == "drop" else F.coalesce(item, _unknown_value(pos, value))

    ids = F.coalesce(F.array_compact(F.transform("fields", found)), F.array().cast("array<bigint>"))
    return records.select(id_col, "fields").crossJoin(F.broadcast(maps)).select(id_col, ids.alias("ids"))


def _encode_by_join(records: DataFrame, dictionary: DataFrame, id_col: str, unknown: str) -> DataFrame:
    same = records.groupBy(id_col, "fields").agg(F.count("*").alias("_copies"))
    cells = same.select(id_col, "fields", "_copies", F.posexplode_outer("fields").alias("pos", "value"))
    found = cells.join(dictionary.withColumn("_known", F.lit(True)), ["pos", "value"], "left")
    if unknown == "error":
        missing = _unknown_value(F.col("pos"), F.col("value"))
        found = found.withColumn("item_id", F.when(F.col("_known") | F.col("pos").isNull(), F.col("item_id")).otherwise(missing))
    cell = F.when(F.col("item_id").isNotNull(), F.struct("pos", "item_id"))
    gathered = found.groupBy(id_col, "fields", "_copies").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    ids = F.transform("_cells", lambda c: c["item_id"]).alias("ids")
    return gathered.select(id_col, ids, F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def class_count(encoded: DataFrame, dictionary: DataFrame | None = None) -> int:
    """Number of classes: the class column was numbered first, so it is its largest id plus one.

    Records that dropped unknown values may lack their class or the largest one; the dictionary, if given, tells it nevertheless.
    """
    if dictionary is None:
        return int(encoded.agg((F.max(F.element_at("ids", -1)) + 1).alias("k")).first()["k"])
    last = dictionary.agg(F.max(F.struct("pos", "item_id")).alias("last")).first()["last"]
    return last["item_id"] + 1 if last else 0


def split_label(ids: Column, num_classes: int) -> tuple[Column, Column]:
    """Items and label of a mixed id array: ids below the number of classes are labels."""
    items = F.filter(ids, lambda x: x >= num_classes)
    label = F.get(F.filter(ids, lambda x: x < num_classes), F.lit(0))
    return items, label


def least_id_label(ids: Column) -> tuple[Column, Column]:
    """Items and label where the label is the least integer of the record."""
    label = F.array_min(ids)
    return F.array_remove(ids, label), label


def to_transactions(encoded: DataFrame, num_classes: int, id_col: str = "rec_id") -> DataFrame:
    items, label = split_label(F.col("ids"), num_classes)
    return encoded.select(id_col, items.alias("items"), label.alias("label"))


def item_array(columns: dict[str, Column], complete: bool = False) -> Column:
    """One "name=value" item per column; a null value gives no item. `complete` says that there are no nulls."""
    items = F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in columns.items()])
    return items if complete else F.array_compact(items)


def equal_width(value: Column, width: float) -> Column:
    """Discretise a number into bins of equal width."""
    return F.floor(value / F.lit(width))
