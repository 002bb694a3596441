import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text, lang, source)) -> DataFrame, short rows filled with nulls."""
    def make(rows, partitions=3):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        data = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full]
        return spark.createDataFrame(data, DOCUMENTS).repartition(partitions)
    return make
