import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns that clash with names used inside or returned.
        T.StructField("id", T.StringType()),
        T.StructField("k", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("node", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns."""

    def make(rows):
        full = []
        for doc_id, text, *source in rows:
            source = source[0] if source else "s"
            full.append((doc_id, text, "en", source, len(text or ""), "x", "y", "z", None))
        return spark.createDataFrame(full, DOCUMENTS)

    return make
