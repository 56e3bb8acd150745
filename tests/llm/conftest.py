import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, shard string, name string, left string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns that clash."""
    word = "lorem ipsum dolor sit amet "
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, None, None, None),
        (None, "no id here", "en", "b"),
        (None, "no id here", "en", "b"),
        (4, word * 4000, "en", "a"),
        (5, word * 4000, "fr", "b"),
        (6, word * 4000 + "x", "fr", "b"),
        (7, "one", "en", "a"),
        (7, "one", "en", "a"),
        (7, "two", "en", "a"),
        (8, "  \t\n ", "en", "a"),
        (9, "   café \U0001f600 é", "fr", "c"),
        (10, "token = Abcdef123456 and hex " + "0af3" * 10, "en", "c"),
    ]
    return spark.createDataFrame([(*r, 1, "r", "s", "n", "l") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
