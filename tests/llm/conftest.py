import pytest

#: Columns of documents, and others whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, id long, shard int, _gone long, _finish double, rank int, n_removed long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and clashing columns."""
    long_ = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta\nsecond line here", "en", "a", 40, 1, "r", 1, 1, 1, 1.0, 1, 0),
        (1, "alpha beta gamma delta\nsecond line here", "en", "a", 40, 1, "r", 1, 1, 1, 1.0, 1, 0),
        (2, None, "en", "a", None, None, None, None, None, None, None, None, None),
        (3, "", None, None, 0, None, None, None, None, None, None, None, None),
        (4, " \n ", "de", "b", 3, 4, "x", 4, 4, 4, 4.0, 4, 4),
        (None, "a text without any number\nsecond line here", "en", "b", 42, None, None, None, None, None, None, None, None),
        (5, long_, "en", "c", len(long_), 5, "r", 5, 5, 5, 5.0, 5, 5),
        (6, long_, "en", "c", len(long_), 5, "r", 5, 5, 5, 5.0, 5, 5),
        (7, "x" * 200_000, None, "c", 200_000, 5, "r", 5, 5, 5, 5.0, 5, 5),
        (8, "word", "en", "a", 4, 5, "r", 5, 5, 5, 5.0, 5, 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
