"""Session factory with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Kryo and Arrow; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
