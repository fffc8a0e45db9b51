"""One place for the session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override. Sizes of shuffles are left to AQE."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=conf | settings).getOrCreate()
