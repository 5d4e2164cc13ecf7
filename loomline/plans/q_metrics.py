"""Detection metrics: labels with a score from the documents' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, stats
from ..operators.views import order_lines
from ..session import table
from .registry import query

_SCORED = "s AS (SELECT doc_id, quality AS y, n_chars AS score, (n_chars > 2000)::INT AS flag FROM labels JOIN documents USING (doc_id))"
_CURVE = f"""
WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM s WHERE score IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g WINDOW w AS (ORDER BY score DESC))
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return rows.withColumn("flag", (F.col("score") > 2000).cast("int"))


_COUNTS = f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND flag = 1) AS fp,
count(*) FILTER (WHERE y = 1 AND flag <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND flag <> 1) AS tn FROM s)"""


@query(f"{_COUNTS} SELECT * FROM c")
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf), "y", "flag")


@query(f"""{_COUNTS} SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification(metrics.confusion(scored(spark, sf), "y", "flag"))


@query(f"{_CURVE} SELECT round(sum(p / tp * cp / (cp + cn)), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(metrics.curve(scored(spark, sf), "y", "score"))


@query(f"""{_CURVE} SELECT round(sum(p / tp * (cp / (cp + cn) + CASE WHEN cp + cn - p - n = 0 THEN 1 ELSE (cp - p) / (cp + cn - p - n) END) / 2), 6) AS pr_auc FROM c""")
def pr_auc_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pr_auc(metrics.curve(scored(spark, sf), "y", "score"))


@query(f"{_CURVE} SELECT round(sum(p * (tn - cn) + p * n / 2) / max(tp * tn), 6) AS roc_auc FROM c")
def roc_auc_midrank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(metrics.curve(scored(spark, sf), "y", "score"))


@query("""
WITH e AS (SELECT event_type, (user_id % 3 = 0)::INT AS y, value AS score FROM events),
g AS (SELECT event_type, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM e GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY score DESC) AS cn, sum(p) OVER (PARTITION BY event_type) AS tp, sum(n) OVER (PARTITION BY event_type) AS tn FROM g)
SELECT event_type, round(sum(p * (tn - cn) + p * n / 2) / max(tp * tn), 6) AS roc_auc FROM c GROUP BY 1
""")
def roc_auc_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3 == 0).cast("int").alias("y"), F.col("value").alias("score"))
    return metrics.roc_auc(metrics.curve(rows, "y", "score", ["event_type"]), ["event_type"])


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), "value")
    truth = e.select("record_id", (F.col("record_id") % 20 == 0).cast("int").alias("is_attack"))
    flagged = lambda v: [(v > 100).cast("int").alias("flag"), v.alias("score")]
    clean = e.select("record_id", *flagged(F.col("value")))
    attacked = e.select("record_id", *flagged(F.when(F.col("record_id") % 20 == 0, F.col("value") * 1.5).otherwise(F.col("value"))))
    return truth, clean, attacked


@query("""
WITH p AS (SELECT value AS s0, value * 1.5 AS s1, (value > 100)::INT AS f0, (value * 1.5 > 100)::INT AS f1 FROM events WHERE event_id % 20 = 0)
SELECT count(*) AS n_attacked, count(*) FILTER (WHERE f0 = 0 AND f1 = 1) AS new_detections, count(*) FILTER (WHERE f0 = 1 AND f1 = 0) AS lost_detections,
       count(*) FILTER (WHERE f0 = f1) AS unchanged, round(avg(s1 - s0), 6) AS mean_change, round(quantile_cont(s1 - s0, 0.5), 6) AS median_change FROM p
""")
def paired_detection(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.paired_detection(*_pair(spark, sf))


@query("""
WITH p AS (SELECT event_id, CASE WHEN event_id % 20 = 0 THEN value * CASE WHEN event_id % 40 = 0 THEN 1 ELSE 1.5 END ELSE value END AS v, value FROM events),
m AS (SELECT (event_id % 20 = 0) AS y, (v > 100) AS f, abs(v - value) > 1e-12 AS vis FROM p)
SELECT count(*) FILTER (WHERE y AND vis) AS n_visible, count(*) FILTER (WHERE y AND NOT vis) AS n_hidden, count(*) FILTER (WHERE y AND vis AND f) AS tp FROM m
""")
def visible_attack_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "value")
    factor = F.when(F.col("event_id") % 40 == 0, 1.0).otherwise(1.5)
    attacked = e.withColumn("value", F.when(F.col("event_id") % 20 == 0, F.col("value") * factor).otherwise(F.col("value")))
    rows = metrics.visible_change(e, attacked, "event_id", ["value"]).join(attacked, "event_id")
    y = F.col("event_id") % 20 == 0
    return rows.agg(
        F.count_if(y & F.col("visible")).alias("n_visible"), F.count_if(y & ~F.col("visible")).alias("n_hidden"), F.count_if(y & F.col("visible") & (F.col("value") > 100)).alias("tp")
    )


@query("""
WITH f AS (SELECT event_id, value AS score, (value > 250)::INT AS flag FROM events)
SELECT event_id, score, flag, event_type FROM f JOIN events USING (event_id)
WHERE flag = 1 OR (SELECT max(flag) FROM f) = 0 ORDER BY score DESC, event_id LIMIT 50
""")
def top_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    scores = e.select("event_id", F.col("value").alias("score"), (F.col("value") > 250).cast("int").alias("flag"))
    return metrics.top_anomalies(scores, e.select("event_id", "event_type"), "event_id", 50)


_SHARES = (0.01, 0.05, 0.1, 0.2)


@query(" UNION ALL ".join(
    f"""SELECT delivery_status, {s} ::DOUBLE AS contamination, round(t, 6) AS threshold, count(*) FILTER (WHERE total > t) AS n_flagged,
    round(100.0 * count(*) FILTER (WHERE total > t) / count(*), 6)::DOUBLE AS percent FROM order_lines, (SELECT quantile_cont(total, {1 - s}::DOUBLE) AS t FROM order_lines) GROUP BY delivery_status, t"""
    for s in _SHARES
))
def contamination_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_lines(spark, sf).select("delivery_status", F.col("total").alias("score"))
    return stats.contamination_sensitivity(rows, _SHARES, ["delivery_status"])
