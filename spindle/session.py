"""Session settings for this package's jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, adaptive execution and push-down; partition counts stay with the cluster's configuration."""
    builder = SparkSession.builder.appName("spindle")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str):
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
