"""A Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "mediadate", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on and all wall clocks in UTC.

    ``conf`` adds or overrides settings by their full names, e.g.
    ``build_session(**{"spark.sql.shuffle.partitions": "4000"})``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
