import os

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    """Python workers may start from another folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", HERE)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long = "the quick brown fox jumps over the lazy dog and runs " * 8000
    rows = [
        (1, "a plain text about nothing much at all", "en", "s1", 38),
        (1, "a plain text about nothing much at all", "en", "s1", 38),
        (1, "another text under the same number", "en", "s1", 34),
        (2, None, "en", "s1", None),
        (3, "", None, None, 0),
        (4, "   \n\t ", "en", "s2", 6),
        (5, long, "en", "s2", len(long)),
        (None, "a text without a number", None, "s2", 23),
        (None, None, None, None, None),
        (6, "12 + 34 = 46", "en", None, 12),
        (7, "ünïcödé \U0001f600 ẞ text", "de", "", 16),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    made = spark.createDataFrame(rows, schema)
    return made.selectExpr(
        "*", "1 AS score", "'x' AS ids", "2 AS size", "3 AS target", "4 AS shard", "5 AS _own_hash", "6 AS fp", "7 AS `a.b`"
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
