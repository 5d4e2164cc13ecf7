"""Sessions and the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC and adaptive execution.

    Partition numbers are left to the cluster; adaptive execution joins small partitions and
    splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
