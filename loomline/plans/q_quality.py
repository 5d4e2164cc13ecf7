"""Cleaning, profiles, duplicates, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import quality, split
from ..operators.views import order_lines
from ..session import table
from .registry import query

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM r
WHERE rn = 1 AND l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 0.09 AND l_shipdate IS NOT NULL
""")
def clean_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.first_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINES)
    test = (F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0) & (F.col("l_discount") < 0.09) & F.col("l_shipdate").isNotNull()
    return rows.filter(test).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("""
SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return quality.first_per_key(table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id) AS user_id FROM events
""")
def ffill_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"))
    return quality.forward_fill(rows, "event_id", ["user_id"], span=1000)


@query("""
WITH t AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS v,
                  CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t, value - 1 AS d FROM events)
SELECT 'v' AS column_name, 'not_numeric' AS check_name, count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS n FROM t
UNION ALL SELECT 't', 'not_a_time', count(*) FILTER (WHERE t IS NOT NULL AND try_cast(t AS TIMESTAMP) IS NULL) FROM t
UNION ALL SELECT 'd', 'negative', count(*) FILTER (WHERE d < 0) FROM t
""")
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"),
        F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"),
        (F.col("value") - 1).alias("d"),
    )
    return quality.quality_counts(e, ["v"], ["t"], ["d"])


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant FROM customer"
    for c in _CUSTOMER
))
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_profile(table(spark, sf, "customer"), _CUSTOMER)


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
        round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem"""
    for c in _NUMERIC
))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numeric_profile(table(spark, sf, "lineitem"), _NUMERIC)


_TOP = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(" UNION ALL ".join(
    f"(SELECT '{c}' AS column_name, {c}::VARCHAR AS top_value, count(*) AS frequency FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1)"
    for c in _TOP
))
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.top_values(table(spark, sf, "lineitem"), _TOP)


@query("""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_duplicate FROM g
""")
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"))


@query("""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT count(*) AS n_keys, sum(n - 1)::BIGINT AS n_duplicate, count(*) FILTER (WHERE n > 1) AS n_repeated_keys, max(n) AS most FROM g
""")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.key_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH r AS (SELECT *, 1 AS one, NULL::VARCHAR AS nothing FROM region), c AS (
  SELECT 'r_regionkey' AS column_name, count(DISTINCT r_regionkey) AS n FROM r UNION ALL SELECT 'r_name', count(DISTINCT r_name) FROM r
  UNION ALL SELECT 'one', count(DISTINCT one) FROM r UNION ALL SELECT 'nothing', count(DISTINCT nothing) FROM r
) SELECT column_name FROM c WHERE n <= 1
""")
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "region").withColumn("one", F.lit(1)).withColumn("nothing", F.lit(None).cast("string"))
    return quality.null_profile(rows).filter("is_constant").select("column_name")


@query("""
SELECT v.value, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(value)
LEFT JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) ON s = v.value
""")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_counts(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


_HASH = "('0x' || substr(sha256('42|' || {k}), 57, 8))::BIGINT % 10000"
_SPLIT = f"CASE WHEN {_HASH} < 7000 THEN 'train' WHEN {_HASH} < 8500 THEN 'validation' ELSE 'test' END"


@query(f"""
SELECT {_SPLIT.format(k='o_orderkey')} AS split, count(*) AS n FROM orders GROUP BY 1
""")
def hash_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return split.hash_split(table(spark, sf, "orders"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n"))


@query("""
WITH per AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM per)
SELECT CASE WHEN b < round_even(t * 0.7, 0) THEN 'train' WHEN b < round_even(t * 0.85, 0) THEN 'validation' ELSE 'test' END AS split,
       sum(n)::BIGINT AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM c GROUP BY 1
""")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = split.chronological_split(table(spark, sf, "orders").select("o_orderdate"), "o_orderdate")
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day")
    )


@query("""
WITH s AS (SELECT l_orderkey AS k, count(*) AS n, sha256('42|' || l_orderkey) AS h FROM lineitem GROUP BY 1),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS place FROM s)
SELECT CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS split, sum(n)::BIGINT AS n, count(*) AS orders FROM c GROUP BY 1
""")
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = split.greedy_group_split(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query(f"""
, t AS (SELECT {_SPLIT.format(k='order_id')} AS split, customer_id FROM order_lines),
k AS (SELECT customer_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM t GROUP BY 1)
SELECT 'train' AS split_a, 'validation' AS split_b, count(*) FILTER (WHERE a AND b) AS n_shared FROM k
UNION ALL SELECT 'train', 'test', count(*) FILTER (WHERE a AND c) FROM k
UNION ALL SELECT 'validation', 'test', count(*) FILTER (WHERE b AND c) FROM k
""")
def identity_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return split.identity_overlap(split.hash_split(order_lines(spark, sf), "order_id"), "customer_id")


@query(f"""
, t AS (SELECT {_SPLIT.format(k='order_id')} AS split, late FROM order_lines)
SELECT split, count(*) AS n, count(*) FILTER (WHERE late = 1) AS n_positive, round(avg(late), 6) AS rate FROM t GROUP BY 1
""")
def target_balance(spark: SparkSession, sf: str) -> DataFrame:
    return split.target_balance(split.hash_split(order_lines(spark, sf), "order_id"), "late")


@query("""
SELECT o_orderkey FROM orders ORDER BY sha256('42|' || o_orderkey), o_orderkey LIMIT 100
""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return split.hash_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("""
WITH e AS (SELECT event_type, user_id % 5 AS seed FROM events WHERE NOT (event_type = 'view' AND user_id % 5 = 3)),
a AS (SELECT event_type, seed, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('view'), ('click'), ('purchase')) t(event_type), (VALUES (0), (1), (2), (3), (4)) s(seed))
SELECT count(p.seed) AS n_planned, count(*) FILTER (WHERE a.seed IS NULL) AS n_missing, count(*) FILTER (WHERE p.seed IS NULL) AS n_unplanned,
       count(*) FILTER (WHERE a.n > 1) AS n_repeated
FROM a FULL JOIN p ON a.event_type = p.event_type AND a.seed = p.seed
""")
def row_set_validation(spark: SparkSession, sf: str) -> DataFrame:
    seed = (F.col("user_id") % 5).cast("int")
    rows = table(spark, sf, "events").select("event_type", seed.alias("seed")).filter(~((F.col("event_type") == "view") & (F.col("seed") == 3)))
    plan = spark.createDataFrame([(t, s) for t in ("view", "click", "purchase") for s in range(5)], "event_type string, seed int")
    return quality.coverage(rows, plan, ["event_type", "seed"])


@query("""
, a AS (SELECT bool_and(quantity > 0) AS v0, bool_and(ship_ts >= order_ts) AS v1, bool_and(discount_rate BETWEEN 0 AND 1) AS v2 FROM order_lines)
SELECT 'positive_quantity' AS check_name, v0 AS passed FROM a UNION ALL SELECT 'shipped_after_order', v1 FROM a UNION ALL SELECT 'rate_in_range', v2 FROM a
""")
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    tests = {
        "positive_quantity": F.col("quantity") > 0,
        "shipped_after_order": F.col("ship_ts") >= F.col("order_ts"),
        "rate_in_range": F.col("discount_rate").between(0, 1),
    }
    return quality.audit(tests, order_lines(spark, sf))


@query("""
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS canonical, least(o_totalprice / 600000, 1) AS s FROM orders)
SELECT o_orderkey, canonical, regexp_full_match(canonical, '[0-9]{4}(-[0-9]{2}){2}T[0-9]{2}(:[0-9]{2}){2}Z') AS ok, o_orderkey::VARCHAR AS id,
       CASE WHEN s < 0.3333 THEN 'LOW' WHEN s < 0.6667 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM t
""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    at = S.canonical_timestamp("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", at.alias("canonical"), S.is_canonical_timestamp(at).alias("ok"), S.canonical_id("o_orderkey").alias("id"),
        S.risk_level(F.least(F.col("o_totalprice") / 600000, F.lit(1.0))).alias("band"),
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
""")
def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))
