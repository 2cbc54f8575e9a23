import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text) rows, in several partitions."""
    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t) for i, t in rows], DOCUMENT).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
