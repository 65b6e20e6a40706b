"""A session with the settings that the queries' results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pricegrain", **conf: str) -> SparkSession:
    """UTC dates and adaptive execution; a master, memory and partitions are left to the caller and the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
