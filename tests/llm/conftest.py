import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("line", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) with extra columns whose names operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, None if i and i % 2 else "en", "s", len(t or ""), "x", None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, a null id."""
    words = " ".join(f"w{k % 97}x{k % 89}" for k in range(20_000))
    return make_docs([(1, None), (2, ""), (3, words), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id here"),
                      (6, words + " end"), (7, "  \n\n "), (8, "é ß 日本 \U0001f600 a b")])
