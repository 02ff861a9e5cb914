"""Session defaults for standalone use; a cluster session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "trailgraph", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. Partition counts are left to AQE, which
    coalesces or splits shuffles from the sizes it sees."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
