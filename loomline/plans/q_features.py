"""Fit-on-train features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import min_max, temporal, unsigned_zero
from ..operators import features, ranks
from ..operators.split import hash_split
from ..operators.views import order_lines
from ..session import table
from .q_quality import _SPLIT
from .registry import query

_S = _SPLIT.format(k="order_id")


@query("""
SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS day_of_week,
       hour(o_orderdate) AS hour, (isodow(o_orderdate) >= 6)::INT AS is_weekend FROM orders
""")
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", *temporal("o_orderdate"))


@query(f"""
, t AS (SELECT order_id, item_id, total, {_S} AS split FROM order_lines),
a AS (SELECT order_id, count(*) AS n, sum(total) AS s FROM t WHERE split = 'train' GROUP BY 1)
SELECT split, count(*) AS n_lines, count(a.n) AS n_seen, round(avg(a.n), 4) AS mean_items, round(avg(a.s), 2) AS mean_value
FROM t LEFT JOIN a USING (order_id) GROUP BY 1
""")
def order_level_features(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: split by order, fit order aggregates on the training rows, look them up, describe each split."""
    rows = hash_split(order_lines(spark, sf).select("order_id", "item_id", "total"), "order_id")
    fitted = features.order_aggregates(rows.filter("split = 'train'"))
    return features.append_order_level(rows, fitted).groupBy("split").agg(
        F.count("*").alias("n_lines"), F.count("order_item_count").alias("n_seen"), F.round(F.avg("order_item_count"), 4).alias("mean_items"),
        F.round(F.avg("order_total_value"), 2).alias("mean_value"),
    )


@query("""
WITH m AS (SELECT l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_quantity / m, 6) AS ratio FROM lineitem JOIN m USING (l_partkey)
""")
def product_mean_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return features.group_mean_ratio(rows, "l_quantity", "l_partkey").withColumn("ratio", F.round("ratio", 6))


@query("""
, m AS (SELECT product_id, avg(quantity) AS mean FROM order_lines GROUP BY 1)
SELECT order_id, line_number, quantity::DOUBLE AS quantity, total::DOUBLE AS total, total / nullif(quantity, 0) AS amount_per_unit, round(ln(1 + total), 6) AS log_total,
       hour(order_ts)::DOUBLE AS hour, (isodow(order_ts) - 1)::DOUBLE AS day_of_week, (isodow(order_ts) >= 6)::INT::DOUBLE AS is_weekend, round(quantity / mean, 6) AS quantity_ratio
FROM order_lines JOIN m USING (product_id)
""")
def basic_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.basic_features(order_lines(spark, sf), ["order_id", "line_number"], ["quantity", "total"], "total", "quantity", "order_ts", "product_id")
    return rows.withColumns({c: F.round(c, 6) for c in ("log_total", "quantity_ratio")})


@query(f"""
, t AS (SELECT department, market FROM order_lines WHERE {_S} = 'train'),
l AS (SELECT 'department' AS column_name, department AS level, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'market', market, count(*) FROM t GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, level) AS level_rank FROM l)
SELECT * FROM r WHERE level_rank <= 15
""")
def topk_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = hash_split(order_lines(spark, sf), "order_id").filter("split = 'train'")
    return features.top_levels(rows, ["department", "market"], 15)


@query("""
SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE AS "c_mktsegment=AUTOMOBILE", (c_mktsegment = 'BUILDING')::INT::DOUBLE AS "c_mktsegment=BUILDING",
       (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING'))::INT::DOUBLE AS "c_mktsegment=__OTHER__" FROM customer
""")
def onehot_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(rows, {"c_mktsegment": ["AUTOMOBILE", "BUILDING"]}).drop("c_mktsegment")


@query("""
, k AS (SELECT department FROM order_lines GROUP BY 1 ORDER BY count(*) DESC, department LIMIT 5)
SELECT CASE WHEN department IN (SELECT department FROM k) THEN department ELSE '__OTHER__' END AS department, count(*) AS n FROM order_lines GROUP BY 1
""")
def other_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_lines(spark, sf).select("department")
    return features.with_other(rows, features.fitted_levels(rows, ["department"], 5)).groupBy("department").agg(F.count("*").alias("n"))


@query(f"""
, t AS (SELECT order_id, item_id, quantity, total, {_S} AS split FROM order_lines),
s AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(total) AS mt, stddev_pop(total) AS st FROM t WHERE split = 'train')
SELECT split, count(*) AS n, round(avg((quantity - mq) / sq), 6) + 0.0 AS mean_q, round(stddev_pop((quantity - mq) / sq), 6) AS sd_q,
       round(avg((total - mt) / st), 6) + 0.0 AS mean_t, round(max((total - mt) / st), 6) AS max_t
FROM t, s GROUP BY 1
""")
def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = hash_split(order_lines(spark, sf).select("order_id", "item_id", "quantity", "total"), "order_id")
    stats = features.fit_scaler(rows.filter("split = 'train'"), ["quantity", "total"])
    return features.scale(rows, stats, ["quantity", "total"]).groupBy("split").agg(
        F.count("*").alias("n"), unsigned_zero(F.round(F.avg("quantity"), 6)).alias("mean_q"), F.round(F.stddev_pop("quantity"), 6).alias("sd_q"),
        unsigned_zero(F.round(F.avg("total"), 6)).alias("mean_t"), F.round(F.max("total"), 6).alias("max_t"),
    )


@query("""
WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents WHERE doc_id % 10 < 7)
SELECT doc_id, round(least(greatest((n_chars - lo) / (hi - lo)::DOUBLE, 0), 1), 6) AS score FROM documents, b
""")
def minmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    bounds = docs.filter("doc_id % 10 < 7").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    rows = docs.join(F.broadcast(bounds))  # one row
    return rows.select("doc_id", F.round(min_max(F.col("n_chars").cast("double"), F.col("lo"), F.col("hi")), 6).alias("score"))


@query("""
WITH m AS (SELECT quantile_cont(CASE WHEN event_id % 5 <> 0 THEN value END, 0.5) AS m FROM events)
SELECT event_id, round(coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, m), 6) AS value FROM events, m
""")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    median = ranks.quantiles(rows, "value", [0.5], ["m"])
    return rows.join(F.broadcast(median)).select("event_id", F.round(F.coalesce("value", "m"), 6).alias("value"))  # one row


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer
""")
def negative_mask(spark: SparkSession, sf: str) -> DataFrame:
    return features.mask_negatives(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("""
WITH t AS (SELECT l_quantity AS raw, (l_quantity - 20) / 3 AS z, l_orderkey % 10 < 7 AS fit FROM lineitem),
l AS (SELECT regr_slope(z, raw) AS a, regr_intercept(z, raw) AS b FROM t WHERE fit)
SELECT round(avg(a * raw + b), 6) AS mean_projected, count(*) AS n, round(max(abs(a * raw + b - z)), 6) AS worst FROM t, l WHERE NOT fit
""")
def affine_projection(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(raw.alias("raw"), ((raw - 20) / 3).alias("z"), (F.col("l_orderkey") % 10 < 7).alias("fit"))
    line = features.fit_affine(rows.filter("fit"), "raw", "z")
    moved = rows.filter("NOT fit").withColumn("p", F.lit(None).cast("double")).withColumn("c", F.lit(True))
    return features.apply_affine(moved, line, "raw", "p", "c").agg(
        F.round(F.avg("p"), 6).alias("mean_projected"), F.count("*").alias("n"), F.round(F.max(F.abs(F.col("p") - F.col("z"))), 6).alias("worst")
    )
