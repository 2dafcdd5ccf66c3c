"""An index of the newest snapshots of a response log: where the payload of every key is.

Per key it has the newest time and id, and the file and row that hold them. The index is a table of runs beside the
log, kept up by narrow scans: each part of the log that is not indexed yet adds its newest rows, and levels of the index
are merged, so neither old payloads nor the whole index are read for a new run.

Newest payloads are read from the files that hold one, and only their rows go on: the index is cut into chunks by file, each
small enough to be sent to every executor and joined there, so that no payload is shuffled however many keys there are.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.operators.responses import ACCEPTED
from snapfolio.operators.store import KEY, STORE_DDL
from snapfolio.sources.runs import FAN, Part, RunTable
from snapfolio.sources.scratch import written
from snapfolio.sources.store_table import LOG_DDL, log_table

INDEX_DDL = (
    "data_type STRING, symbol STRING, last_updated TIMESTAMP_NTZ, id BIGINT, since INT, folder STRING, "
    "file STRING, row BIGINT, usable BOOLEAN"
)
#: Rows of the index that are sent to the executors at once: about 200 bytes each in memory.
CHUNK_ROWS = 250_000


def _table(spark: SparkSession, path: str) -> RunTable:
    return RunTable(spark, f"{path.rstrip('/')}/_newest")


def _best(rows: DataFrame) -> DataFrame:
    """The newest row per key. Of a snapshot that folding has written twice, the later copy."""
    order = ["last_updated", "id", "since", "folder", "file", "row", "usable"]
    best = rows.groupBy(*KEY).agg(F.max(F.struct(order)).alias("_v"))
    return best.select(*KEY, "_v.*")


def _of_part(log: RunTable, part: Part) -> DataFrame:
    """The newest rows within one part of the log. Payloads are not read."""
    rows = log.read(f"{LOG_DDL}, run STRING", [part]).filter(F.col("outcome") == ACCEPTED)
    return _best(
        rows.select(
            *KEY, "last_updated", "id", F.lit(part.since).alias("since"), F.lit(part.folder).alias("folder"),
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "usable",
        )
    )


def update_index(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Take up the parts of the log that are not in the index yet.

    Folding moves rows, and the later copy counts. Where rows went away, since a run was replaced, what was next
    newest is not known any more, and the index is made anew from narrow columns.
    """
    log, index = log_table(spark, path), _table(spark, path)
    parts = log.listed()
    if index.listed().epoch != parts.epoch:
        index.change(lambda now: replace(now, epoch=parts.epoch, parts=()))
    known = index.listed().runs
    for part in parts.parts:
        if part.folder not in known:
            folder = index.new_folder()
            _of_part(log, part).write.parquet(index.folder(folder))
            index.enter(folder, [part.folder], once=True)
    index.fold(lambda some, folder: _best(index.read(INDEX_DDL, some)).write.parquet(folder), fan)


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The index: a row per key, as of the last ``update_index``. What is read does not grow with the number of runs."""
    return _best(_table(spark, path).read(INDEX_DDL))


def _chunks(rows: DataFrame, most: int) -> list[list[tuple[str, str, str]]]:
    """The files that hold newest rows, in order, in chunks of about ``most`` rows. Only names of files come to the
    driver, which lists them for any scan."""
    files = rows.groupBy("folder", "data_type", "file").agg(F.count("*").alias("n"))
    chunks, held = [], most
    for folder, data_type, file, n in sorted(files.collect()):
        if held + n > most:
            chunks.append([])
            held = 0
        chunks[-1].append((folder, data_type, file))
        held += n
    return chunks


def latest_of_log(
    spark: SparkSession,
    path: str,
    data_type: str | None = None,
    only_usable: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The newest snapshot of every (data type, symbol) of a log, or of every symbol of one type, by the index.

    The same rows as ``latest_snapshot`` of the log's store. With ``only_usable`` those of ``nonempty_latest``; payloads of other keys
    are not read. Takes up new runs first. A key whose newest time and id occur twice is taken from the later run.
    """
    update_index(spark, path)
    rows = newest_rows(spark, path)
    if data_type is not None:
        rows = rows.filter(F.col("data_type") == data_type)
    if only_usable:
        rows = rows.filter("usable")
    rows = written(rows.select("data_type", "folder", "file", "row"), "newest")
    log = log_table(spark, path)
    place = F.struct("folder", "data_type", "file")
    columns = [c.split()[0] for c in STORE_DDL.split(", ")]
    found = []
    for chunk in _chunks(rows, chunk_rows):
        first, last = (F.struct(*map(F.lit, end)) for end in (chunk[0], chunk[-1]))
        wanted = rows.filter((place >= first) & (place <= last)).select(
            F.col("data_type").alias("_type"), F.col("file").alias("_file"), F.col("row").alias("_row")
        )
        files = [f"{log.folder(folder)}/outcome={ACCEPTED}/data_type={kind}/{file}" for folder, kind, file in chunk]
        scan = spark.read.schema(f"{LOG_DDL}, run STRING").option("basePath", log.path).parquet(*files)
        scan = scan.select(
            *columns, F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r")
        )
        same = (F.col("data_type") == F.col("_type")) & (F.col("_f") == F.col("_file")) & (F.col("_r") == F.col("_row"))
        # At most ``chunk_rows``, or those of one file.
        found.append(scan.join(F.broadcast(wanted), same, "left_semi").select(columns))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], STORE_DDL)
