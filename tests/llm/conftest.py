import pytest

LONG = "word" * 5000 + " " + "tail " * 3000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n \x0b", "en"),
    (None, "a text without a number that is long enough to have shingles", "en"),
    (6, LONG, "en"),
    (7, "日本語 テキスト é ﬁ \U0001f600 <|endoftext|> </s>", "xx"),
    (8, "one two", None),
    (9, "#*$%&|<> ### \\ ⁠", "de"),
    (10, "first line of some length that is repeated in another document\nsecond\n\nthird\nfourth\nfifth", "en"),
    (11, "first line of some length that is repeated in another document\nsecond\n\nthird\nfourth\nother", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and shared ids, and columns whose names the operators use inside."""
    rows = [(i, t, lang, "src", len(t or ""), 1, "n", "h", "x", "v", "w") for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, n string, h string, word string, kept string, language string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
