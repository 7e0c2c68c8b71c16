"""Spark session factory and the settings the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; every session that runs the engine has them.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.groupByOrdinal": "false",
}

#: Settings that change speed only.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword settings (dots as in Spark) win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **SEMANTICS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings that change results on a session made elsewhere."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
