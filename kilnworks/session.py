"""Spark sessions tuned for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "kilnworks", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
