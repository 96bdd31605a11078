"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .shipping import ship


def session(app: str = "stihora", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster master and partitions come from its configuration."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())
