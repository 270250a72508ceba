"""Odd rows for the tests of the text operators."""

import pytest
from pyspark.sql import types as T

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("score", T.StringType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("secrets", T.StringType()),
        ]
    )
    body = " ".join(f"word{i} the of" for i in range(40))
    rows = [
        (1, None, None, None, None, None),
        (2, "", "en", "x", 1, "s"),
        (None, "some text here", "en", None, 2, None),
        (4, LONG, "en", "y", 3, "s"),
        (5, "x" * 60_000, None, "y", 3, "s"),
        (6, body, "en", "z", 4, None),
        (6, body, "en", "z", 4, None),
        (7, body, None, "z", 4, None),
        (8, "  \t\n ", "de", "z", 4, None),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
