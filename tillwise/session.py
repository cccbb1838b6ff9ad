"""A session with the settings that the bench uses."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No call-site capture for each column expression: plans are built a quarter faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tillwise", master: str | None = None, **extra: str) -> SparkSession:
    """Create or fetch a session.  Cluster sizing is left to spark-submit and spark-defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
