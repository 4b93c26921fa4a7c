import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the others in the wood today"
    rows = [
        (1, base, "en", "a", 5, "x", "y"),
        (2, base, "en", "a", 5, "x", "y"),
        (2, base, "en", "a", 5, "x", "y"),
        (3, "", None, None, None, None, None),
        (4, None, "en", "b", None, None, None),
        (None, base + " again", "de", "b", 1, None, None),
        (5, "word " * 30_000, "fr", "b", 1, None, None),
        (6, "x" * 200_000, "fr", "b", 1, None, None),
        (7, "  \n\t tabs\x0band\x0c more\r\n  ünïcode 日本語 😀   end ", "xx", "", 1, None, None),
        (8, "Mail a.b@c.de, call +49 (30) 1234-567 or 10.0.0.255; card 4111 1111 1111 1111!", "en", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (5, 0, 0), (6, 0, 1), (8, 1, 1), (8, 0, 1), (None, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
