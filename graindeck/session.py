"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and Arrow; other settings stay the cluster's own."""
    builder = SparkSession.builder.appName("graindeck")
    if master:
        builder = builder.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
