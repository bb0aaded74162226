"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC days, adaptive execution with skew handling; further settings by keyword, dots as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
