import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from snapfolio.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store_of(spark):
    """Build a store from (id, data_type, symbol, day, raw_data) tuples."""

    def build(*rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(
            list(rows), "id BIGINT, data_type STRING, symbol STRING, day STRING, raw_data STRING"
        )
        return df.select(
            "id", "data_type", "symbol",
            F.col("day").cast("timestamp_ntz").alias("last_updated"), "raw_data",
        )

    return build


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(name="rows")
def rows_fixture():
    return rows
