import pytest
from pyspark.sql import functions as F

from ruleloom.operators.indexing import global_index
from ruleloom.plans.cli import read_transactions
from ruleloom.sources import text


@pytest.fixture(scope="module")
def lines_df(spark):
    values = ["|head", "a,x,p", "b,x,q", "", "|head", "a,y,p", "a,x,p"]
    rows = [(f"r{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rec_id string, value string").coalesce(1)


def test_header_lines_and_blank_lines_are_dropped_but_duplicates_stay(lines_df):
    kept = [r["rec_id"] for r in text.parse_records(lines_df).orderBy("rec_id").collect()]
    assert kept == ["r1", "r2", "r5", "r6"]


def test_no_header_keeps_bar_lines(spark):
    df = spark.createDataFrame([("a,b",), ("|x,y",)], "value string").coalesce(1)
    assert text.parse_records(df).count() == 2


@pytest.mark.parametrize(
    ("value", "separator", "fields"),
    [("a,b,,", ",", ["a", "b"]), (",a", ",", ["", "a"]), ("1 2 3", " ", ["1", "2", "3"]), ("a|b", "|", ["a", "b"])],
)
def test_split(spark, value, separator, fields):
    df = spark.createDataFrame([(value,)], "value string")
    assert df.select(text.split_fields(F.col("value"), separator).alias("f")).first()["f"] == fields


def test_dictionary_numbers_classes_first(lines_df):
    rows = text.build_dictionary(text.parse_records(lines_df)).orderBy("item_id").collect()
    assert [tuple(r[c] for c in ("pos", "value", "item_id")) for r in rows] == [
        (2, "p", 0), (2, "q", 1), (1, "x", 2), (1, "y", 3), (0, "a", 4), (0, "b", 5),
    ]


def test_encode_and_split_label(lines_df):
    records = text.parse_records(lines_df)
    encoded = text.encode(records, text.build_dictionary(records))
    assert text.class_count(encoded) == 2
    rows = {r["rec_id"]: (r["items"], r["label"]) for r in text.to_transactions(encoded, 2).collect()}
    assert rows == {"r1": ([4, 2], 0), "r2": ([5, 2], 1), "r5": ([4, 3], 0), "r6": ([4, 2], 0)}


def test_encode_by_map_and_by_join_are_equal(spark, lines_df):
    """A small dictionary is looked up without a shuffle of the records; a repeated or large one is joined."""
    dictionary = text.build_dictionary(text.parse_records(lines_df))
    rows = [("r", ["a", "x", "p"]), ("r", ["a", "x", "p"]), (None, ["b"]), ("e", []), ("n", None), ("o", ["a", None, "zz"])]
    records = spark.createDataFrame(rows, "rec_id string, fields array<string>")
    got = [
        sorted(map(str, text.encode(records, d, unknown="drop", map_limit=limit).collect()))
        for d, limit in ((dictionary, 1000), (dictionary, 5), (dictionary.where("item_id >= 0"), 6))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6
    plan = text.encode(records, dictionary, unknown="drop")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list(struct(pos" in plan
    twice = dictionary.unionByName(dictionary.withColumn("item_id", dictionary.item_id + 100))
    assert [len(r["ids"]) for r in text.encode(records.where("rec_id = 'r'"), twice).collect()] == [6, 6]
    with pytest.raises(Exception, match="value not in the dictionary"):
        text.encode(records, dictionary).collect()


def test_class_count_after_dropped_class_values(spark, lines_df):
    """A class value that the dictionary lacks is dropped: what is then last in its record is an item, no class."""
    dictionary = text.build_dictionary(text.parse_records(lines_df))
    records = spark.createDataFrame([("n1", ["a", "x", "p"]), ("n2", ["b", "y", "other"])], "rec_id string, fields array<string>")
    encoded = text.encode(records, dictionary, unknown="drop")
    assert text.class_count(encoded, dictionary) == 2
    rows = {r["rec_id"]: (r["items"], r["label"]) for r in text.to_transactions(encoded, 2).collect()}
    assert rows == {"n1": ([4, 2], 0), "n2": ([5, 3], None)}


def test_least_id_is_the_label(spark):
    items, label = text.least_id_label(F.col("ids"))
    row = spark.createDataFrame([([7, 1, 9],)], "ids array<bigint>").select(items.alias("i"), label.alias("l")).first()
    assert (row["i"], row["l"]) == ([7, 9], 1)


def test_global_index_follows_the_order(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(10**9))).repartition(7)
    rows = sorted(global_index(df, [F.desc("v")], "at").collect(), key=lambda r: -r["v"])
    assert [r["at"] for r in rows] == list(range(1000))


def test_text_file_to_transactions(spark, tmp_path):
    path = tmp_path / "records.txt"
    path.write_text("|bins\n5.8-Inf,3.0-Inf,versicolor\n\n-Inf-5.8,3.0-Inf,setosa\n5.8-Inf,-Inf-3.0,versicolor\n")
    tx, classes = read_transactions(spark, str(path))
    assert classes == 2
    assert sorted((len(r["items"]), r["label"]) for r in tx.collect()) == [(2, 0), (2, 1), (2, 1)]
