"""One place that builds a session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "wayfold", **extra: str) -> SparkSession:
    """A session for this library. ``master`` is only for local use; a cluster names its own."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
