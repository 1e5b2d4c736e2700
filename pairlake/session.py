"""Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC timestamps, ANSI arithmetic, adaptive plans with skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "pairlake", **settings: str) -> SparkSession:
    """The active session, or a new one; keyword settings use "_" for "."."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
