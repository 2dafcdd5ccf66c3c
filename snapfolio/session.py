"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffle partitions: many small ones are asked for and
# merged at run time, oversized ones are split. Tables of newest keys take about 20 bytes
# per key on disk and five times that in memory: up to 64 MB (three million keys) they
# are worth sending to every executor, since payloads then stay where they are.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # The first requests of a day are cut before they are shuffled, also for months at a time.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "snapfolio", **settings: str) -> SparkSession:
    """A session with the settings above; master and sizes come from the cluster."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
