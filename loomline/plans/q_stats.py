"""The statistics kernel over observations: events as (classifier, seed, repetition, metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..session import table
from .registry import query

_OBS = "obs AS (SELECT event_id, event_type AS cfg, user_id % 5 AS seed, CAST(json_extract(props, '$.k') AS INT) % 10 AS rep, value FROM events)"
_SEED = f"{_OBS}, per AS (SELECT cfg, seed, avg(value) AS v FROM obs GROUP BY ALL)"
_PAIRS = f"{_SEED}, pairs AS (SELECT c.cfg, c.seed, c.v, b.v AS base, c.v - b.v AS d FROM per c JOIN per b ON c.seed = b.seed AND b.cfg = 'view' WHERE c.cfg <> 'view')"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("cfg"), (F.col("user_id") % 5).alias("seed"), (F.from_json("props", "k int").k % 10).alias("rep"), "value"
    )


def per_seed(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("cfg", "seed").agg(F.avg("value").alias("v"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired(per_seed(spark, sf), "cfg", "view", [], "seed", "v")


@query(f"""
WITH {_OBS} SELECT cfg, seed, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS min,
round(quantile_cont(value, 0.5), 4) AS median, round(max(value), 4) AS max, round(100 * stddev_samp(value) / abs(avg(value)), 4) AS cv_percent FROM obs GROUP BY ALL
""")
def group_describe(spark: SparkSession, sf: str) -> DataFrame:
    return stats.group_describe(observations(spark, sf), ["cfg", "seed"], "value")


@query(f"""
WITH {_OBS}, i AS (SELECT cfg, seed, avg(value) AS m, 100 * stddev_samp(value) / abs(avg(value)) AS cv FROM obs GROUP BY ALL)
SELECT cfg, count(*) AS n_seeds, round(avg(m), 4) AS mean_of_means, round(100 * stddev_samp(m) / abs(avg(m)), 4) AS between_cv, round(avg(cv), 4) AS within_cv,
       arg_max(seed, cv) AS most_variable_seed FROM i GROUP BY 1
""")
def two_level_cv(spark: SparkSession, sf: str) -> DataFrame:
    return stats.two_level(observations(spark, sf), ["cfg"], "seed", "value")


@query(f"""
WITH {_PAIRS}, a AS (SELECT cfg, count(d) AS n_pairs, avg(d) AS m, stddev_samp(d) AS s, bool_and(d < 0) AS below, bool_and(d > 0) AS above,
count(*) FILTER (WHERE d < 0) AS n_below, count(*) FILTER (WHERE d = 0) AS n_equal, count(*) FILTER (WHERE d > 0) AS n_above, quantile_cont(d, 0.5) AS med FROM pairs GROUP BY 1),
h AS (SELECT *, CASE WHEN n_pairs = 5 THEN {stats.T_975_DF4} * s / sqrt(5) END AS half FROM a)
SELECT cfg, n_pairs, round(m, 6) AS mean_difference, round(s, 6) AS sd_difference, round(m - half, 6) AS ci_low, round(m + half, 6) AS ci_high,
       CASE WHEN m - half > 0 THEN 'increase' WHEN m + half < 0 THEN 'reduction' ELSE 'uncertain' END AS effect,
       CASE WHEN below THEN 'all_below' WHEN above THEN 'all_above' ELSE 'mixed' END AS direction, n_below, n_equal, n_above, round(med, 6) AS median_difference FROM h
""")
def paired_t_ci(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired_interval(_pairs(spark, sf), ["cfg"])


@query(f"""
WITH {_PAIRS} SELECT cfg, seed, round(greatest((base - v) / base, 0), 6) AS loss_v, greatest((base - v) / base, 0) <= 0.05 + 1e-12 AS preserved FROM pairs
""")
def preservation_margins(spark: SparkSession, sf: str) -> DataFrame:
    rows = per_seed(spark, sf)
    out = stats.preservation(rows.filter("cfg <> 'view'"), rows.filter("cfg = 'view'"), ["seed"], {"v": 0.05})
    return out.select("cfg", "seed", F.round("loss_v", 6).alias("loss_v"), "preserved")


@query("""
SELECT l_returnflag, sum((l_shipdate < TIMESTAMP '1998-01-01')::INT)::BIGINT AS numerator, sum(l_linenumber)::BIGINT AS denominator,
       round(sum((l_shipdate < TIMESTAMP '1998-01-01')::INT) / sum(l_linenumber), 6) AS rate FROM lineitem GROUP BY 1
""")
def pooled_rate(spark: SparkSession, sf: str) -> DataFrame:
    early = (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).cast("int")
    rows = table(spark, sf, "lineitem").select("l_returnflag", early.alias("early"), "l_linenumber")
    return stats.pooled_rate(rows, ["l_returnflag"], "early", "l_linenumber")


@query(f"WITH {_PAIRS} SELECT seed, cfg, round(v / base, 6) AS ratio FROM pairs WHERE base > 0")
def normalized_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return stats.normalized_ratios(per_seed(spark, sf), ["seed"], "cfg", "view", "v")


@query(f"""
WITH {_PAIRS} SELECT cfg, seed, CASE WHEN base - v > 0 THEN ceil(100 / (base - v))::BIGINT END AS repetitions, round(100 * (base - v) / base, 6) AS reduction FROM pairs
""")
def break_even(spark: SparkSession, sf: str) -> DataFrame:
    saving = F.col("base") - F.col("v")
    return _pairs(spark, sf).select(
        "cfg", "seed", stats.break_even(F.lit(100.0), saving).cast("long").alias("repetitions"), F.round(stats.reduction_percent(F.col("base"), F.col("v")), 6).alias("reduction")
    )


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
))
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pearson_matrix(table(spark, sf, "lineitem"), _NUM)


@query(f"""
WITH {_OBS}, r AS (SELECT cfg, rank() OVER (PARTITION BY cfg ORDER BY value) + (count(*) OVER (PARTITION BY cfg, value) - 1) / 2 AS a,
rank() OVER (PARTITION BY cfg ORDER BY rep) + (count(*) OVER (PARTITION BY cfg, rep) - 1) / 2 AS b FROM obs)
SELECT cfg, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1
""")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(observations(spark, sf), "value", "rep", ["cfg"])


_ITEMS = "i AS (SELECT p_size AS item, round(avg(p_retailprice), 2) AS x, count(*)::DOUBLE AS y FROM part GROUP BY 1)"


@query(f"""
WITH {_ITEMS}, p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS tx, (a.y <> b.y)::INT AS ty FROM i a JOIN i b ON a.item < b.item)
SELECT count(*) AS n_pairs, round(sum(s) / sqrt(sum(tx) * sum(ty)), 6) AS tau_b FROM p
""")
def kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").groupBy(F.col("p_size").alias("item")).agg(F.round(F.avg("p_retailprice"), 2).alias("x"), F.count("*").cast("double").alias("y"))
    return stats.kendall_tau_b(rows, "item", "x", "y")


@query(" UNION ALL ".join(
    f"""SELECT * FROM (WITH g AS (SELECT l_returnflag AS y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS s FROM lineitem GROUP BY 1),
    t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
    SELECT '{c}' AS column_name, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 4) AS f FROM g, t)""" for c in _NUM
))
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return stats.anova_f(table(spark, sf, "lineitem"), _NUM, "l_returnflag")


_CAT = ["l_linenumber", "l_linestatus"]


@query(" UNION ALL ".join(
    f"""SELECT * FROM (WITH g AS (SELECT {c} AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM g)
    SELECT '{c}' AS column_name, round(greatest(sum(n / t * ln(n::DOUBLE * t / (nx::DOUBLE * ny))), 0), 6) AS mi FROM t)""" for c in _CAT
))
def discrete_mi(spark: SparkSession, sf: str) -> DataFrame:
    return stats.discrete_mutual_information(table(spark, sf, "lineitem"), _CAT, "l_returnflag")


@query("""
WITH v AS (SELECT var_pop(l_quantity) AS a, var_pop(l_tax) AS b, var_pop(1.0) AS c FROM lineitem)
SELECT 'l_quantity' AS column_name FROM v WHERE a > 0 UNION ALL SELECT 'l_tax' FROM v WHERE b > 0 UNION ALL SELECT 'one' FROM v WHERE c > 0
""")
def variance_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).cast("double").alias("one"))
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in rows.columns])))
    return long.groupBy("column_name").agg(F.var_pop("v").alias("s")).filter("s > 0").select("column_name")


@query("""
WITH t AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 + l_tax AS c, l_discount AS d FROM lineitem),
r AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(b, c)) AS bc FROM t)
SELECT 'c' AS dropped, 'a' AS blocker, round(ac, 6) AS r FROM r WHERE ac >= 0.95
""")
def corr_filter_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.filters import correlation_filter

    x = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("c"), F.col("l_discount").alias("d")
    )
    _, dropped = correlation_filter(x, ["a", "b", "c", "d"], 0.95)
    return spark.createDataFrame([(c, b, round(r, 6)) for c, b, r in dropped], "dropped string, blocker string, r double")


_SETS = """w AS (SELECT s_nationkey AS k, p_brand AS item, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
m AS (SELECT k, sum(q) AS total, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT w.k, list(item) AS items FROM w JOIN m USING (k) WHERE q * n > total GROUP BY 1)"""


def brand_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The brands that each nation's suppliers ship more of than of its average brand."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    amounts = rows.groupBy(F.col("s_nationkey").alias("k"), F.col("p_brand").alias("item")).agg(F.sum("l_quantity").alias("q"))
    # a row a nation and brand by now
    listed = amounts.groupBy("k").agg(F.sum("q").alias("total"), F.collect_list(F.struct("item", "q")).alias("all"))
    large = F.filter("all", lambda x: x.q * F.size("all") > F.col("total"))
    return listed.select("k", F.transform(large, lambda x: x.item).alias("items"))


@query(f"""
WITH {_SETS} SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))), 6) AS jaccard
FROM s a JOIN s b ON a.k < b.k
""")
def seed_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pairwise_jaccard(brand_sets(spark, sf), "k", "items")


@query(f"""
WITH {_SETS} SELECT a.k AS a, b.k AS b, array_to_string(list_sort(list_intersect(a.items, b.items)), ',') AS both,
array_to_string(list_sort(list_filter(a.items, lambda x: NOT list_contains(b.items, x))), ',') AS only_a,
array_to_string(list_sort(list_filter(b.items, lambda x: NOT list_contains(a.items, x))), ',') AS only_b FROM s a JOIN s b ON a.k < b.k
""")
def overlap_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.overlap_blocks(brand_sets(spark, sf), "k", "items")


@query(f"WITH {_SETS} SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM s) GROUP BY 1")
def feature_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_frequency(brand_sets(spark, sf), "items")


@query(f"WITH {_SETS} SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM s) GROUP BY 1 HAVING count(*) >= 4")
def consensus_sets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_frequency(brand_sets(spark, sf), "items", 4)


@query(f"""
WITH {_OBS}, g AS (SELECT cfg, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY cfg ORDER BY e.event_id) AS gap FROM obs JOIN events e USING (event_id))
SELECT cfg, round(max(gap) / 1e6, 3) AS longest, round(avg(gap) / 1e6, 3) AS mean, count(*) FILTER (WHERE gap / 1e6 > 1800) AS n_over FROM g GROUP BY 1
""")
def timing_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("cfg"), "ts")
    return stats.timing_quality(rows, ["cfg"], "event_id", "ts", 1800)


@query("""
WITH g AS (SELECT user_id, event_id, (event_id * 37) % 1000 AS c, lag((event_id * 37) % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, event_id, CASE WHEN c < b THEN 1000 - b + c ELSE c - b END::DOUBLE AS delta FROM g
""")
def counter_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", ((F.col("event_id") * 37) % 1000).cast("double").alias("c"))
    return stats.counter_delta(rows, ["user_id"], "event_id", "c", 1000.0).select("user_id", "event_id", "delta")


@query("""
WITH g AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best,
max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT user_id, event_id, best, coalesce(value > before, true) AS improved FROM g
""")
def convergence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    return stats.running_best(rows, ["user_id"], "event_id", "value").select("user_id", "event_id", "best", "improved")


@query("""
SELECT event_type, round(sum(value) / 512, 6) AS s_per_operation, round(sum(value) / count(*), 6) AS s_per_record, round(count(*) / sum(value), 6) AS records_per_s,
       round(sum(value) * 68, 4) AS energy_j FROM events GROUP BY 1
""")
def latency_energy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("w"), F.count("*").cast("double").alias("n"))
    parts = stats.latency_and_throughput(F.col("w"), F.lit(512.0), F.col("n"))
    return rows.select("event_type", *[F.round(v, 6).alias(k) for k, v in parts.items()], F.round(stats.energy_estimate_j(F.col("w")), 4).alias("energy_j"))


@query("SELECT l_returnflag, bool_and(l_quantity < 50) AS all_small, bool_or(l_quantity >= 50) AS any_large FROM lineitem GROUP BY 1")
def boolean_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.bool_and(F.col("l_quantity") < 50).alias("all_small"), F.bool_or(F.col("l_quantity") >= 50).alias("any_large"))
