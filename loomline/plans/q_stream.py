"""Batch forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..session import table
from .registry import query


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def window_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = streaming.window_stats(table(spark, sf, "events"))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH g AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800 * 1000000) AS cut FROM events),
s AS (SELECT user_id, ts, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = streaming.session_stats(table(spark, sf, "events"))
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id // 8 + 1 AS block_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) = 8")
def block_rollover(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.block_rollover(table(spark, sf, "events"), "event_id")
