import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """DataFrame from rows; columns whose type is 'ts' are given as text."""
    from pyspark.sql import functions as F

    def make(rows, schema):
        cols = [c.rsplit(" ", 1) for c in schema.split(", ")]
        df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if t == 'ts' else t}" for n, t in cols))
        return df.select(*[F.to_timestamp(n).alias(n) if t == "ts" else F.col(n) for n, t in cols])
    return make
