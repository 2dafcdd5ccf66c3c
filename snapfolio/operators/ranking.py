"""First rows per key, safe for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_SALTS = 32


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = "rank",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The first ``n`` rows of every key under ``order``, numbered from 1 in ``rank``.

    ``order`` must be total within a key, or ties are broken arbitrarily.

    Spark keeps only ``n`` rows per key and task before it shuffles (window group
    limit). A key spread over very many tasks would still send ``n`` rows from each
    of them to one task, so the rows are first reduced per (key, salt). The salt is
    the number of the map task, which keeps each task at ``n`` rows per key; the
    result does not depend on it. Use ``salts=1`` where keys are known to be small.
    """
    keys = list(keys)
    if salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") <= n)
            .drop("_rank", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)
