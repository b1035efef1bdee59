import pytest
from pyspark.sql import types as T

ODD_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("token", T.StringType()),
])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, repeated ids, clashing extra columns."""
    long_text = "alpha beta gamma " * 40_000 + "mail a.b@c.example.org token = abcdefghijkl0123 " + "x" * 50_000
    rows = [
        (1, None, None, None, None, "s", "t"),
        (2, "", "en", "a", 0, "s", None),
        (3, "one", "en", "a", 3, None, "t"),
        (4, long_text, "en", "a", len(long_text), "s", "t"),
        (5, "the same words stand here again and again", "en", "b", 1, "s", "t"),
        (5, "the same words stand here again and again", "en", "b", 1, "s", "t"),
        (6, "The SAME words\tstand here again and\nagain", "en", "b", 1, "s", "t"),
        (7, " \n\t ", "en", "b", 4, "s", "t"),
        (8, "éè \U0001f600 +1 (555) 123-4567 é 4111 1111 1111 1111, 192.168.0.1", "fr", "b", 9, "s", "t"),
        (None, "no id at all for this text", "en", "b", 9, "s", "t"),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
