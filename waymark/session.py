"""The session that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "waymark", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; further settings by keyword with "_" for "."."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
