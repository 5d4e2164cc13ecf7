"""Reports, selectors as operators, and the order chains' further records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, experiments, metrics, reports, selectors
from ..operators.views import order_lines
from ..session import table
from .q_chain import _HASHES, _workload_sql, chains
from .q_stats import _NUM, _OBS, _PAIRS, _pairs, observations
from .registry import query

_SPLIT = "CASE WHEN seed < 3 THEN 'train' WHEN seed = 3 THEN 'validation' ELSE 'test' END"


@query(f"""
WITH {_OBS}, s AS (SELECT cfg, value, {_SPLIT} AS split FROM obs),
g AS (SELECT cfg, avg(value) FILTER (WHERE split = 'validation') AS v, avg(value) FILTER (WHERE split = 'test') AS t FROM s GROUP BY 1)
SELECT cfg, round(v, 6) AS validation, round(t, 6) AS test, round(t - v, 6) AS gap FROM g
""")
def generalisation_gap(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("seed") < 3, "train").when(F.col("seed") == 3, "validation").otherwise("test")
    return reports.generalisation_gap(observations(spark, sf).withColumn("split", split), ["cfg"], "split", "value")


@query(f"""
WITH {_PAIRS} SELECT cfg, count(d) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(min(d), 6) AS min, round(max(d), 6) AS max,
count(*) FILTER (WHERE d < 0) AS negative, count(*) FILTER (WHERE d = 0) AS zero, count(*) FILTER (WHERE d > 0) AS positive,
CASE WHEN count(*) FILTER (WHERE d < 0) > 0 THEN 'REVIEW' ELSE 'PASS' END AS safeguard FROM pairs GROUP BY 1
""")
def paired_signs(spark: SparkSession, sf: str) -> DataFrame:
    return reports.paired_signs(_pairs(spark, sf), ["cfg"])


@query(f"""
WITH {_OBS}, r AS (SELECT cfg, seed, count(*) AS requests, count(DISTINCT rep) AS evaluated, count(*) - count(DISTINCT rep) AS hits, round(sum(value), 6) AS seconds FROM obs GROUP BY ALL)
SELECT cfg, count(*) AS runs, sum(requests)::BIGINT AS requests, sum(evaluated)::BIGINT AS evaluated, sum(hits)::BIGINT AS hits, round(sum(seconds), 6) AS seconds,
bool_and(requests = evaluated + hits) AS consistent FROM r GROUP BY 1
""")
def search_accounting(spark: SparkSession, sf: str) -> DataFrame:
    runs = observations(spark, sf).groupBy("cfg", "seed").agg(
        F.count("*").alias("requests"), F.countDistinct("rep").alias("evaluated"), F.round(F.sum("value"), 6).alias("seconds")
    )
    return reports.search_accounting(runs.withColumn("hits", F.col("requests") - F.col("evaluated")), ["cfg"])


@query(f"""
WITH {_OBS} SELECT cfg, count(*) AS n, printf('%.3f', avg(value)) || ' ± ' || printf('%.3f', stddev_samp(value)) AS value,
printf('%.3f', avg(rep)) || ' ± ' || printf('%.3f', stddev_samp(rep)) AS rep FROM obs GROUP BY 1
""")
def publication_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows come in the order in which the classifiers are told."""
    facts = reports.publication_table(observations(spark, sf), ["cfg"], ["value", "rep"])
    return reports.by_rank(facts, "cfg", ["view", "click", "purchase"])


_AUDIT = [("c_custkey", "identifier"), ("c_name", "categorical"), ("c_nationkey", "identifier"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")]


@query(
    "WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment), t AS (SELECT sum(n)::BIGINT AS n, count(*) AS k FROM g), x AS ("
    "SELECT 'rows' AS section, 'n_rows' AS item, n::VARCHAR AS value FROM t UNION ALL SELECT 'rows', 'n_distinct', k::VARCHAR FROM t UNION ALL SELECT 'rows', 'n_duplicate', (n - k)::VARCHAR FROM t"
    + "".join(
        f" UNION ALL SELECT 'n_null', '{c}', (count(*) - count({c}))::VARCHAR FROM customer UNION ALL SELECT 'n_distinct', '{c}', count(DISTINCT {c})::VARCHAR FROM customer"
        f" UNION ALL SELECT 'leakage', '{c}', 'nearly unique' FROM customer HAVING count(DISTINCT {c}) >= 0.95 * count(*)"
        for c, _ in _AUDIT
    )
    + ") SELECT 'customer' AS source, * FROM x"
)
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All sections that are computed from rows; roles go by names and are left to the tests."""
    found = reports.full_audit(table(spark, sf, "customer"), "customer")
    return found.filter("section IN ('rows', 'n_null', 'n_distinct') OR value = 'nearly unique'")


@query("""
WITH a AS (SELECT doc_id, quality AS is_attack, (n_chars > 2000)::INT AS flag, doc_id % 3 <> 0 AS visible FROM labels JOIN documents USING (doc_id)),
j AS (SELECT * FROM a WHERE is_attack = 0 OR visible)
SELECT count(*) FILTER (WHERE is_attack = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE is_attack <> 1 AND flag = 1) AS fp,
count(*) FILTER (WHERE is_attack = 1 AND flag <> 1) AS fn, count(*) FILTER (WHERE is_attack <> 1 AND flag <> 1) AS tn FROM j
""")
def visible_only_confusion(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    truth = labels.select("doc_id", F.col("quality").alias("is_attack"))
    flags = docs.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("flag"))
    seen = docs.select("doc_id", (F.col("doc_id") % 3 != 0).alias("visible"))
    judged = reports.visible_only(truth, flags, seen, "doc_id")
    return metrics.confusion(judged, "is_attack", "flag")


@query("""
SELECT event_id, event_type AS key_type, user_id AS key_user, value AS fact_value, CAST(json_extract(props, '$.k') AS INT) AS fact_detail_k FROM events
""")
def flat_observations(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("key"),
        F.struct("value", F.from_json("props", "k int").alias("detail")).alias("fact"),
    )
    return reports.flat(nested)


# selectors


@query(f"""WITH RECURSIVE c(column_name, pos) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_NUM))}),
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 12) AS r FROM lineitem" for a in _NUM for b in _NUM if a != b)}),
m AS (SELECT a, avg(r) AS mean FROM p GROUP BY 1),
o AS (SELECT column_name, pos, mean FROM c JOIN m ON a = column_name),
s AS (SELECT 0 AS n, []::VARCHAR[] AS done UNION ALL
  SELECT n + 1, list_append(done, (SELECT arg_min(column_name, (coalesce(w, 0), mean, pos)) FROM
    (SELECT o.column_name, o.pos, o.mean, (SELECT max(r) FROM p WHERE p.a = o.column_name AND list_contains(s.done, p.b)) AS w FROM o) z WHERE NOT list_contains(s.done, z.column_name)))
  FROM s WHERE n < {len(_NUM)})
SELECT done[position] AS column_name, position::INT AS position FROM (SELECT done, unnest(range(1, {len(_NUM) + 1})) AS position FROM s WHERE n = {len(_NUM)}) t""")
def redundancy_ranking(spark: SparkSession, sf: str) -> DataFrame:
    chosen = selectors.create("redundancy")(table(spark, sf, "lineitem"), _NUM)
    order = sorted(chosen.columns, key=chosen.scores.get)
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "column_name string, position int")


@query("SELECT column_name, (row_number() OVER (ORDER BY f DESC NULLS LAST, place))::INT AS position FROM (" + " UNION ALL ".join(
    f"""SELECT * FROM (WITH g AS (SELECT l_returnflag AS y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS s FROM lineitem GROUP BY 1),
    t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
    SELECT '{c}' AS column_name, {i} AS place, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM g, t)""" for i, c in enumerate(_NUM)
) + ") ORDER BY position LIMIT 2")
def anova_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return selectors.ranked(selectors.create("anova")(rows, _NUM, "l_returnflag", 2), rows)


_CAT = ["l_linenumber", "l_linestatus", "l_discount"]


@query("SELECT column_name, (row_number() OVER (ORDER BY mi DESC, place))::INT AS position FROM (" + " UNION ALL ".join(
    f"""SELECT * FROM (WITH g AS (SELECT {c} AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM g)
    SELECT '{c}' AS column_name, {i} AS place, round(greatest(sum(n / t * ln(n::DOUBLE * t / (nx::DOUBLE * ny))), 0), 12) AS mi FROM t)""" for i, c in enumerate(_CAT)
) + ") ORDER BY position LIMIT 2")
def mi_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return selectors.ranked(selectors.create("mutual_information")(rows, _CAT, "l_returnflag", 2), rows)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def selector_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that vary, in their order, for all rows: fitted on two thirds of the orders."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(1.0).alias("one"), "l_tax")
    chosen = selectors.create("variance")(rows.filter("l_orderkey % 3 <> 0"), ["l_quantity", "one", "l_tax"])
    return chosen.transform(rows, ["l_orderkey", "l_linenumber"])


# chains


@query(f"{_HASHES} SELECT oid AS order_id, s3 AS before, s4 AS head FROM h4")
def extended_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of four events, and their heads once the risk assessment is appended."""
    events = chain.order_events(order_lines(spark, sf))
    four = chain.build_chains(events.withColumn("risk_score", F.lit(None).cast("string")))
    five = chain.extend_chains(four, events.select("order_id", "risk_score"))
    return five.select("order_id", F.element_at("chain", 4).block_hash.alias("before"), F.element_at("chain", -1).block_hash.alias("head"))


@query(f"""{_workload_sql()} SELECT seed, workload, count(*) AS orders, count(*) FILTER (WHERE level = 'LOW') AS low, count(*) FILTER (WHERE level = 'MEDIUM') AS medium,
count(*) FILTER (WHERE level = 'HIGH') AS high, sha256(string_agg(order_id, ',' ORDER BY position)) AS digest FROM wl GROUP BY ALL""")
def workload_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.manifest(experiments.workloads(chains(spark, sf)))


@query(f"{_HASHES} SELECT count(*) AS n_chains, count(*) FILTER (WHERE order_id % 10 <> 0) AS n_records, count(*) FILTER (WHERE order_id % 10 = 0) AS n_without_record, "
       "0::BIGINT AS n_without_chain, count(*) FILTER (WHERE order_id % 10 = 1 AND sha256('other') <> rd) AS n_mismatched FROM h4")  # fmt: skip
def record_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth order has lost its record, and every tenth has another's digest."""
    rows = chains(spark, sf)
    n = F.col("order_id").cast("long") % 10
    digest = F.when(n == 1, F.sha2(F.lit("other"), 256)).otherwise(F.element_at("chain", -1).ai_risk_reference.record_digest)
    return reports.record_coverage(rows, rows.filter(n != 0).select("order_id", digest.alias("record_digest")))


@query(f"""{_HASHES}, t AS (SELECT level, CASE level WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 6 ELSE 8 END AS n FROM h4)
SELECT level, array_to_string(list_transform(range(1, n + 1), lambda i: 'c' || i), ',') AS passed, '' AS failed, count(*) AS orders FROM t GROUP BY ALL""")
def verdict_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = chain.verdict_lists(chain.with_checks(chains(spark, sf).withColumn("expected_id", F.col("order_id"))))
    text = lambda c: F.array_join(c, ",").alias(c)
    return rows.groupBy("level", text("passed"), text("failed")).agg(F.count("*").alias("orders"))
