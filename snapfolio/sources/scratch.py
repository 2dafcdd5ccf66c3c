"""Folders for intermediate tables that every executor can reach."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Lets Spark remove a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of tables that are sent to every task: some 64 MB. Beyond it they are joined by shuffling.
SENT_ROWS = 2_000_000

#: The tables written in each open ``passing`` block, by path, innermost last.
_OPEN: ContextVar[tuple[dict[str, DataFrame], ...]] = ContextVar("open", default=())


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"snapfolio-{application}-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, and Spark runs in this process alone, a temporary
    folder of this machine is used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    # Not local-cluster, whose executors are processes of their own.
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(spark.conf.get("spark.app.id", "local"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nobody else uses."""
    return f"{scratch_root(spark)}/snapfolio/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, of known size, and safe
    from the loss of executors. Nothing of its shuffles stays on disk."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A query is told to clean up when it is formed.
        df.select("*").write.parquet(path, **options)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if _OPEN.get():
        _OPEN.get()[-1][path] = table
    return table


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose ``written`` tables are deleted at its end, but for those given to the function it yields, which
    returns them. These belong to the block around it, if there is one."""
    own: dict[str, DataFrame] = {}
    staying: list[DataFrame] = []

    def stay(table: DataFrame) -> DataFrame:
        staying.append(table)
        return table

    around = _OPEN.get()
    token = _OPEN.set((*around, own))
    try:
        yield stay
    except BaseException:
        # What went wrong in the block is told, not what goes wrong in clearing up after it.
        for path in list(own):
            with suppress(Exception):
                _delete(own.pop(path).sparkSession, path)
        raise
    finally:
        _OPEN.reset(token)
        for path, table in own.items():
            if not any(table is t for t in staying):
                _delete(table.sparkSession, path)
            elif around:
                around[-1][path] = table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sent(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, to be sent to every task if it is small; else joins shuffle it."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= SENT_ROWS else table
