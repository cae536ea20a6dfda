"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(name: str = "gridlark", **conf: str) -> SparkSession:
    """UTC days and adaptive plans; anything else (master, memory, shuffle partitions) is the caller's, by conf or spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or in local mode under the warehouse where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top or spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
