"""Skylines, rankings, reshaping, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape, select
from ..session import table
from .q_stats import _OBS, _SEED, observations, per_seed
from .registry import query

_POINTS = "p AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS gain, (s_suppkey * 37) % 101 AS cost FROM supplier)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("gain"), ((F.col("s_suppkey") * 37) % 101).alias("cost")
    )


@query(f"""
WITH {_POINTS} SELECT g, k, gain, cost FROM p WHERE NOT EXISTS (
SELECT 1 FROM p o WHERE o.g = p.g AND o.gain >= p.gain AND o.cost <= p.cost AND (o.gain > p.gain OR o.cost < p.cost))
""")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return select.skyline(points(spark, sf), ["g"], ["gain"], ["cost"]).select("g", "k", "gain", "cost")


@query(f"""
WITH {_POINTS} SELECT p.g, p.k, count(o.k) AS n_dominators, coalesce(string_agg(o.k::VARCHAR, ',' ORDER BY o.k::VARCHAR), '') AS dominators FROM p
LEFT JOIN p o ON o.g = p.g AND o.gain >= p.gain AND o.cost <= p.cost AND (o.gain > p.gain OR o.cost < p.cost) GROUP BY p.g, p.k
""")
def dominated_by(spark: SparkSession, sf: str) -> DataFrame:
    return select.dominated_by(points(spark, sf), ["g"], "k", ["gain"], ["cost"])


@query(f"""
WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (gain >= 5000)::INT DESC, CASE WHEN gain >= 5000 THEN cost END NULLS LAST,
CASE WHEN gain < 5000 THEN 5000 - gain END NULLS LAST, gain DESC, k) AS rn FROM p) SELECT g, k, gain, cost FROM r WHERE rn = 1
""")
def constrained_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("gain") >= 5000
    order = select.constrained_order(ok, F.col("cost"), 5000 - F.col("gain"), [F.col("gain")], F.col("k"))
    return select.winners(points(spark, sf), ["g"], order).select("g", "k", "gain", "cost")


@query(f"""
WITH {_SEED}, m AS (SELECT cfg, avg(v) AS v FROM per GROUP BY 1), b AS (SELECT v AS base FROM m WHERE cfg = 'view')
SELECT cfg FROM m, b WHERE v >= 0.9 * base AND cfg <> 'view' ORDER BY length(cfg), v DESC, cfg LIMIT 1
""")
def smallest_preserving(spark: SparkSession, sf: str) -> DataFrame:
    m = per_seed(spark, sf).groupBy("cfg").agg(F.avg("v").alias("v"))
    base = m.filter("cfg = 'view'").select(F.col("v").alias("base"))
    rows = m.filter("cfg <> 'view'").join(F.broadcast(base)).filter("v >= 0.9 * base").withColumn("one", F.lit(1))  # one row
    return select.winners(rows, ["one"], [F.length("cfg").asc(), F.desc("v"), F.col("cfg").asc()]).select("cfg")


@query(f"WITH {_OBS} SELECT seed, " + ", ".join(f"round(avg(value) FILTER (WHERE cfg = '{c}'), 4) AS {c}" for c in ("view", "click", "purchase")) + " FROM obs GROUP BY 1")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.pivot(observations(spark, sf), ["seed"], "cfg", ["view", "click", "purchase"], F.round(F.avg("value"), 4))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS metric, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem
""")
def metric_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.unpivot(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"])


@query(f"""
WITH {_SEED}, p AS (SELECT seed, max(v) FILTER (WHERE cfg = 'view') AS b, max(v) FILTER (WHERE cfg = 'click') AS c FROM per GROUP BY 1)
SELECT seed, round(100 * (b - c) / b, 6) AS reduction FROM p
""")
def reduction_table(spark: SparkSession, sf: str) -> DataFrame:
    p = reshape.pivot(per_seed(spark, sf), ["seed"], "cfg", ["view", "click"], F.max("v"))
    return p.select("seed", F.round(F.try_divide(100 * (F.col("view") - F.col("click")), F.col("view")), 6).alias("reduction"))


_DIGEST = """sha256('{"order_id":"' || o_orderkey || '","seed":522}')"""


@query(f"""
WITH r AS (SELECT o_orderkey AS order_id, {_DIGEST} AS digest FROM orders)
SELECT order_id, digest, row_number() OVER (ORDER BY digest, order_id) AS position FROM r ORDER BY digest, order_id LIMIT 1000
""")
def hash_rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    return select.hash_rank(table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), "order_id", 522, 1000)


@query(f"""
WITH r AS (SELECT o_orderkey AS order_id, row_number() OVER (ORDER BY {_DIGEST}, o_orderkey) AS position FROM orders)
SELECT w.workload, count(*) AS n, sum(order_id)::BIGINT AS checksum FROM r JOIN (VALUES (100), (250), (500), (1000)) w(workload) ON position <= w.workload GROUP BY 1
""")
def nested_workloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = select.nested_workloads(hash_rank_orders(spark, sf), [100, 250, 500, 1000])
    return rows.groupBy("workload").agg(F.count("*").alias("n"), F.sum("order_id").alias("checksum"))


@query("""
SELECT s.scenario, w.workload, ('0x' || substr(sha256('{"scenario":"' || s.scenario || '","seed":522,"workload":' || w.workload || '}'), 57, 8))::BIGINT % w.workload AS target
FROM (VALUES ('PA-01'), ('PA-05')) s(scenario), (VALUES (100), (250), (500)) w(workload)
""")
def attack_target_index(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.createDataFrame([(100,), (250,), (500,)], "workload int")
    parts = [w.select(F.lit(s).alias("scenario"), "workload", select.target_index(522, s, F.col("workload"), F.col("workload")).alias("target")) for s in ("PA-01", "PA-05")]
    return parts[0].unionByName(parts[1])


@query("""
SELECT b.block, p.place, (p.place - b.block + 4) % 4 AS turn FROM (VALUES (0), (1), (2), (3)) b(block), (VALUES (0), (1), (2), (3)) p(place)
""")
def rotated_schedule(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.createDataFrame([(b, p) for b in range(4) for p in range(4)], "block int, place int")
    return select.rotated_schedule(cells, "block", "place", 4)


@query("SELECT ('0x' || substr(sha256('7|' || o_orderkey), 57, 8))::BIGINT % 7 AS kind, count(*) AS n FROM orders GROUP BY 1")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return select.round_robin(table(spark, sf, "orders"), 7, "o_orderkey", 7).groupBy(F.col("kind").cast("long").alias("kind")).agg(F.count("*").alias("n"))
