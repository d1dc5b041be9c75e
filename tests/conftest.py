from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import LogStore, configure
from emberlog.plans.tables import stored_columns
from emberlog.session import scratch
from tests.oracle_check import session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return configure(session("4"))


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan, uncut."""
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "formatted")


@pytest.fixture(scope="session")
def new_store(spark):
    return lambda: LogStore(spark, scratch(spark, "test-store"))


@pytest.fixture
def store(new_store) -> LogStore:
    return new_store()


@pytest.fixture(scope="session")
def logs(spark):
    """Build log rows from (timestamp, level, service, message, attributes) tuples."""

    def build(rows):
        full = [
            (f"{number:04d}", *row, *[{}] * (5 - len(row))) for number, row in enumerate(rows)
        ]
        schema = (
            "id STRING, text STRING, level STRING, service STRING, message STRING, "
            "attributes MAP<STRING,STRING>"
        )
        df = spark.createDataFrame(full, schema)
        return stored_columns(df.withColumn("timestamp", F.col("text").cast("timestamp"))).drop(
            "text"
        )

    return build
