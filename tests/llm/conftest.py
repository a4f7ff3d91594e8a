from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids, and columns with names that operators use inside."""
    long = " ".join(f"word{i % 1013} thing." for i in range(9_000))
    rows = [
        (1, "One two three four five six.", "en", "a", 28),
        (1, "One two three four five six.", "en", "a", 28),
        (1, "another text with the same id", "en", None, None),
        (2, None, "en", "a", 0),
        (3, "", None, "a", 0),
        (None, "no id here at all, none", "de", "b", 1),
        (None, None, None, None, None),
        (4, " \n\t ", "fr", "b", 4),
        (5, long, "en", "b", len(long)),
        (6, long + " end", "en", "b", 1),
        (7, "12 34 %% ##", "es", "b", 1),
        (8, "été à Noël ß 日本 <|endoftext|>", "fr", "b", 1),
    ]
    table = spark.createDataFrame(rows, DOCS)
    return table.selectExpr("*", "1 as row_a", "'x' as root", "2 as part", "'y' as words", "3 as start", "4L as set_id", "5 as k")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
