import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield session.tune(s)


@pytest.fixture
def val(spark):
    """Evaluate column expressions over one row of named values."""

    def run(expr, schema="x string", **values):
        df = spark.createDataFrame([tuple(values.values())] if values else [("",)], schema)
        return df.select(expr.alias("v")).first()[0]

    return run
