"""A session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """On a cluster the master and the number of shuffle partitions come from its own configuration."""
    builder = SparkSession.builder.appName("petrel").config(map=SETTINGS | settings)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    return builder.getOrCreate()
