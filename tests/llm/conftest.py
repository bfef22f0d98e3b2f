import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "one two three four five six", "en", "x", 1, 1),
        (1, "one two three four five six", "en", "x", 1, 1),
        (2, None, None, None, None, None),
        (3, "", "en", "", 0, 0),
        (None, "one two three four five six", "xx", "y", 2, 2),
        (4, " \t\n\x0b ", "de", "x", 3, 3),
        (5, "word " * 30_000, "en", "x", 4, 4),
        (6, "x" * 100_000, "en", "x", 5, 5),
        (7, "One\ttwo three\nfour  five six\n\nseven", "fr", "x", 6, 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h long, score long")


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)
