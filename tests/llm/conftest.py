import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int"

LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards mix strong potions"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeats, clashing columns."""
    rows = [
        (1, "Hello there, " + PASSAGE + ".", "en", "a", 3, 0.1, 1),
        (2, "Well: " + PASSAGE + "!", "en", "a", None, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "", 0, 0.5, 2),
        (5, " \t\n ", "fr", None, 3, 0.5, 2),
        (6, LONG, "en", "a", 9, 0.5, 2),
        (7, LONG, None, "b", 9, 0.5, 2),
        (8, "ébène façade naïve 日本語 🙂", "fr", "b", 1, 0.5, 2),
        (None, "Hello there, " + PASSAGE + ".", "en", "a", 3, 0.1, 1),
        (None, None, None, None, None, None, None),
        (2, "Well: " + PASSAGE + "!", "en", "a", None, None, None),
        (9, "12345 67890 !!! ???", "de", "a", 1, 0.5, 2),
        (10, "\n".join(["same line here again"] * 40), "en", "a", 1, 0.5, 2),
        (11, "aaaaaaaaaaaaaaaaaaaaaaaa" * 10, "en", "a", 1, 0.5, 2),
        (12, "one", "en", "c", 1, 0.5, 2),
        (13, "<|endoftext|> literal <|endoftext|>", "en", "c", 1, 0.5, 2),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
