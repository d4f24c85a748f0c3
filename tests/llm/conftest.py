import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs_of(spark):
    """Documents of (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""
    def make(rows, partitions=3):
        full = [(tuple(r) + (None, "s"))[:2] + ((tuple(r) + ("en",))[2], (tuple(r) + ("en", "s"))[3] if len(r) > 3 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(partitions)
        for name in ("fp", "h", "node", "shard", "rank", "score", "block", "start", "key"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark):
    """A given table, and its rows as dicts."""
    def read(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")
    return read
