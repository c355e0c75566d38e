import pytest

ODD = [
    None, "", " \n\t ", "one", "two words", "a b c d e f g h", "it's I'LL they've 123 45a ½ ²",
    "İstanbul ΑΣ ΟΔΟΣ <|endoftext|> x<|startoftext|>y", "aaa aaaa aaaaa ", " \n\n  a\t\tb \x1c\x1d x\x85y　z",
    "é ﬁ 日本語テキスト emoji 👩‍👩‍👧 힣", "\x00\x01 \x7f", "a" * 300, "!!!???...---___" * 20, "Straße STRASSE straße " * 40,
    "same text again and again in here", "same text again and again in here", "word " * 3000, "ab cd ef gh ij kl mn " * 2000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null, empty, tied, repeated and very long texts, a null id, and columns whose names clash."""
    rows = [(i, t, None if i % 3 else "x", 1) for i, t in enumerate(ODD)] + [(5, ODD[5], "x", 1), (None, "no id at all", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < 0")
