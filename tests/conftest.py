import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ciphersift.session import get_spark
    s = get_spark("local[8]", app="ciphersift-tests", shuffle_partitions=8)
    yield s


@pytest.fixture
def corpus(spark):
    from ciphersift.sources.corpus import from_rows
    from pyspark.sql import functions as F

    def make(files: dict):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        return from_rows(df, F.col("path"), F.col("content"))
    return make
