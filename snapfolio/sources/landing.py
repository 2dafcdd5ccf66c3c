"""Landed API responses: files some fetcher outside of Spark has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.functions import utc_time
from snapfolio.operators.responses import CORRUPT_LINE, LANDING_DDL, process_responses
from snapfolio.sources.store_table import append_log


#: Formats whose files are text: times are read as they stand there, and lines that are not understood are kept.
TEXT_FORMATS = ("json", "csv")


def _schema(fmt: str) -> str:
    if fmt not in TEXT_FORMATS:
        return LANDING_DDL
    return LANDING_DDL.replace("ts TIMESTAMP_NTZ", "ts STRING") + f", {CORRUPT_LINE} STRING"


def _understood(landed: DataFrame) -> DataFrame:
    return landed if CORRUPT_LINE not in landed.columns else landed.withColumn("ts", utc_time(F.col("ts")))


def read_landed(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Landed responses as a batch, from JSON lines, Parquet or another file format.

    Times with a zone are turned into UTC, others are taken as they are. A line that is no JSON object, or has
    a field of another type, has its text in ``corrupt_line`` beside the fields that could be read.
    """
    options = {"columnNameOfCorruptRecord": CORRUPT_LINE, **options}
    return _understood(spark.read.schema(_schema(fmt)).format(fmt).options(**options).load(path))


def stream_landed(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """The same as a stream over the files of a folder."""
    options = {"columnNameOfCorruptRecord": CORRUPT_LINE, **options}
    return _understood(spark.readStream.schema(_schema(fmt)).format(fmt).options(**options).load(path))


def ingest_landed_payloads(landed: DataFrame, log_path: str, run: str | None = None) -> None:
    """Classify landed responses and append them to the response log.

    One write holds both the snapshots and the requests they cost, so the two can never
    disagree. Name the ``run`` to be able to repeat it: it replaces its own folder.
    """
    append_log(process_responses(landed), log_path, run)
