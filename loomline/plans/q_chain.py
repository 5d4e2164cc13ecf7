"""Hash chains: ledger, order chains, checks, tampering, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import json_string
from ..operators import chain, experiments
from ..operators.views import order_lines
from ..session import table
from .registry import query

_TX = """tx AS (SELECT event_id AS id, sha256('{"event":"' || event_type || '","id":' || event_id || ',"user":' || user_id || '}') AS d FROM events)"""


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    digest = chain.transaction_hash({"event": json_string("event_type"), "id": F.col("event_id"), "user": F.col("user_id")})
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), digest.alias("d"))


@query(f"WITH {_TX} SELECT id, d FROM tx")
def tx_hash(spark: SparkSession, sf: str) -> DataFrame:
    return transactions(spark, sf)


_BLOCKS = f"{_TX}, b AS (SELECT id // 8 + 1 AS block_id, count(*) AS n, sha256(string_agg(d, '|' ORDER BY id)) AS tx_root, min(id) AS first, max(id) AS last FROM tx GROUP BY 1)"


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def ledger_blocks_of_8(spark: SparkSession, sf: str) -> DataFrame:
    return chain.ledger(transactions(spark, sf), "id", "d")


_LINKS = f"""{_BLOCKS}, c AS (
  SELECT (block_id - 1) // 64 AS ledger_id, block_id, sha256('genesis|' || (block_id - 1) // 64) AS previous_hash,
         sha256(block_id || '|' || sha256('genesis|' || (block_id - 1) // 64) || '|' || tx_root) AS block_hash FROM b WHERE (block_id - 1) % 64 = 0
  UNION ALL
  SELECT c.ledger_id, b.block_id, c.block_hash, sha256(b.block_id || '|' || c.block_hash || '|' || b.tx_root) FROM c JOIN b ON b.block_id = c.block_id + 1 WHERE (b.block_id - 1) % 64 <> 0
)"""


@query(f"WITH RECURSIVE {_LINKS} SELECT * FROM c")
def ledger_links(spark: SparkSession, sf: str) -> DataFrame:
    return chain.link_ledger(ledger_blocks_of_8(spark, sf)).select("ledger_id", "block_id", "previous_hash", "block_hash")


def _verify_sql(edited: str) -> str:
    """The checks of all blocks, with the digests of transactions that are ``edited`` after sealing."""
    return f"""
WITH RECURSIVE {_LINKS}, e AS (SELECT id // 8 + 1 AS block_id, sha256(string_agg(CASE WHEN {edited} THEN sha256('edited') ELSE d END, '|' ORDER BY id)) AS root FROM tx GROUP BY 1),
p AS (SELECT *, coalesce(lag(block_hash) OVER (PARTITION BY ledger_id ORDER BY block_id), sha256('genesis|' || ledger_id)) AS before FROM c),
v AS (SELECT block_id, root = tx_root AS content_ok, sha256(block_id || '|' || previous_hash || '|' || root) = block_hash AS hash_ok, previous_hash = before AS link_ok
FROM p JOIN b USING (block_id) JOIN e USING (block_id))"""


@query(f"{_verify_sql('false')} SELECT * FROM v")
def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    blocks = ledger_blocks_of_8(spark, sf)
    return chain.verify_ledger(chain.link_ledger(blocks), blocks)


@query(f"{_verify_sql('id % 1000 = 77')} SELECT * FROM v WHERE NOT (content_ok AND hash_ok AND link_ok)")
def tamper_report(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions edited after sealing: their blocks fail, their links still hold."""
    tx = transactions(spark, sf)
    edited = tx.withColumn("d", F.when(F.col("id") % 1000 == 77, F.sha2(F.lit("edited"), 256)).otherwise(F.col("d")))
    report = chain.verify_ledger(chain.link_ledger(chain.ledger(tx, "id", "d")), chain.ledger(edited, "id", "d"))
    return report.filter("NOT (content_ok AND hash_ok AND link_ok)")


_SEALS = f"""{_LINKS}, z0 AS (SELECT ledger_id AS part, count(*) AS n, sha256(ledger_id || '|' || count(*) || '|' || arg_max(block_hash, block_id)) AS digest FROM c GROUP BY 1)""" + "".join(
    f", z{i} AS (SELECT part // 64 AS part, sum(n)::BIGINT AS n, sha256(string_agg(part || ':' || digest, '|' ORDER BY part)) AS digest FROM z{i - 1} GROUP BY 1)" for i in range(1, 5)
)


@query(f"WITH RECURSIVE {_SEALS} " + " UNION ALL ".join(f"SELECT {i} AS level, part, n, digest FROM z{i}" for i in range(5)))
def ledger_seals(spark: SparkSession, sf: str) -> DataFrame:
    return chain.ledger_seals(chain.link_ledger(ledger_blocks_of_8(spark, sf)))


@query(f"""WITH RECURSIVE {_LINKS}, l AS (SELECT DISTINCT ledger_id AS k, ledger_id % 3 = 1 AS lost FROM c)
""" + " UNION ALL ".join(f"SELECT {i} AS level, k // {64 ** i} AS part, NOT bool_or(lost) AS ok FROM l GROUP BY 2" for i in range(5)))
def ledger_lost(spark: SparkSession, sf: str) -> DataFrame:
    """Whole ledgers go after sealing: the links of the others hold, the seals above the lost ones do not."""
    linked = chain.link_ledger(ledger_blocks_of_8(spark, sf))
    return chain.verify_seals(linked.filter("ledger_id % 3 <> 1"), chain.ledger_seals(linked))


_LINES = """
, d AS (SELECT order_id, item_id, sha256('{"order_id":"' || order_id || '","quantity":' || quantity::BIGINT || ',"status":"' || order_status || '","total_cents":' ||
       round(total * 100)::BIGINT || ',"transaction_id":"' || item_id || '"}') AS d FROM order_lines),
i AS (SELECT order_id, item_id, min(d) AS digest, count(*) AS n_rows, count(DISTINCT d) AS n_variants FROM d GROUP BY ALL)
"""
_ORDERS = f"""{_LINES}, o AS (SELECT order_id, sha256('[' || string_agg('"' || digest || '"', ',' ORDER BY item_id) || ']') AS digest, count(*) AS n_lines,
count(*) FILTER (WHERE n_variants > 1) AS n_conflicts FROM i GROUP BY 1)"""


@query(f"{_ORDERS} SELECT * FROM o")
def order_line_digest(spark: SparkSession, sf: str) -> DataFrame:
    return chain.order_digests(order_lines(spark, sf))


@query(f"{_LINES} SELECT order_id, item_id, n_rows, n_variants FROM i WHERE n_variants > 1")
def order_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return chain.line_digests(order_lines(spark, sf)).filter("n_variants > 1").select("order_id", "item_id", "n_rows", "n_variants")


@query(", c AS (SELECT order_id, count(DISTINCT order_status) = 1 AND count(DISTINCT delivery_status) = 1 AS consistent FROM order_lines GROUP BY 1) SELECT * FROM c")
def order_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return chain.order_consistency(order_lines(spark, sf), ["order_status", "delivery_status"])


@query("""
, p AS (SELECT order_id, count(*) AS n FROM order_lines GROUP BY 1)
SELECT count(*) AS orders, sum(n)::BIGINT AS lines, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS p75 FROM p
""")
def mapping_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = order_lines(spark, sf).groupBy("order_id").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("orders"), F.sum("n").alias("lines"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"),
        F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.75)).alias("p75"),
    )


_TS = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_CHAIN = f"""{_ORDERS}, e AS (
  SELECT order_id::VARCHAR AS oid, {_TS.format('min(order_ts)')} AS created, {_TS.format('greatest(min(order_ts), min(ship_ts))')} AS shipped,
         {_TS.format('greatest(min(order_ts), max(ship_ts))')} AS delivered, min(delivery_status) AS ds, floor(100 * sum(late) / count(*))::BIGINT AS h, order_id FROM order_lines GROUP BY order_id
), f AS (SELECT e.*, o.digest, CASE WHEN h = 100 THEN '1.00' ELSE '0.' || lpad(h::VARCHAR, 2, '0') END AS score FROM e JOIN o USING (order_id)
), g AS (SELECT *, CASE WHEN score::DOUBLE < 0.3333 THEN 'LOW' WHEN score::DOUBLE < 0.6667 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM f
), r AS (SELECT *, '"generation_stage_provenance":"synthetic","hybrid_k13_provenance":"synthetic","model_configuration_provenance":"synthetic","order_id":"' || oid || '",' AS head FROM g
), q AS (SELECT *, sha256('{{' || head || '"risk_level":"' || level || '","risk_score":' || score || '}}') AS rd FROM r
), k AS (SELECT *, '{{' || head || '"record_digest":"' || rd || '","risk_level":"' || level || '","risk_score":' || score || '}}' AS ref FROM q
), b0 AS (SELECT *, sha256('{{"order_creation_canonical":"' || created || '","order_id":"' || oid || '"}}') AS p0 FROM k
)"""


def _level(n: int, ref: str, ts: str, event: str, payload: str, previous: str, policy: str) -> str:
    link = f"'\"' || {previous} || '\"'" if previous else "'null'"
    return (
        f", h{n} AS (SELECT *, '{{\"ai_risk_reference\":' || {ref} || ',\"block_index\":{n},\"event_timestamp\":\"' || {ts} || '\",\"event_type\":\"{event}\",\"order_id\":\"' || oid || "
        f"'\",\"payload_digest\":\"' || {payload} || '\",\"payload_ref\":null,\"previous_hash\":' || {link} || ',\"schema_version\":\"1.1\",\"validation_policy\":\"AUTHORIZED_VALIDATOR_' || {policy} || '\"}}' "
        f"AS t{n}, sha256(t{n}) AS s{n} FROM {'b0' if n == 0 else f'h{n - 1}'})"
    )


_HASHES = (
    _CHAIN
    + _level(0, "'null'", "created", "ORDER_GENESIS", "p0", "", "'MEDIUM'")
    + _level(1, "'null'", "created", "ORDER_CREATED", "digest", "s0", "'MEDIUM'")
    + _level(2, "'null'", "shipped", "SHIPMENT_RECORDED", """sha256('{"order_id":"' || oid || '","shipped":"' || shipped || '"}')""", "s1", "'MEDIUM'")
    + _level(3, "'null'", "delivered", "DELIVERY_STATUS_RECORDED", """sha256('{"delivery_status":"' || ds || '","order_id":"' || oid || '"}')""", "s2", "'MEDIUM'")
    + _level(4, "ref", "delivered", "AI_RISK_ASSESSED", "sha256(ref)", "s3", "level")
)


def chains(spark: SparkSession, sf: str) -> DataFrame:
    return chain.build_chains(chain.order_events(order_lines(spark, sf)))


@query(f"{_HASHES} SELECT oid AS order_id, s0 AS genesis, s4 AS head FROM h4")
def order_chain_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chains(spark, sf).select("order_id", F.element_at("chain", 1).block_hash.alias("genesis"), F.element_at("chain", 5).block_hash.alias("head"))


@query(f"""{_HASHES}, x AS (SELECT substr(sha256(oid), 1, 3) AS b, sha256(string_agg(oid || ':' || s4, ',' ORDER BY oid || ':' || s4)) AS d, count(*) AS n FROM h4 GROUP BY 1)
SELECT sha256(string_agg(d, ',' ORDER BY b)) AS root, sum(n)::BIGINT AS n FROM x""")
def global_root(spark: SparkSession, sf: str) -> DataFrame:
    return chain.global_root(order_chain_blocks(spark, sf), "order_id", "head")


_LEVELS = """, l AS (SELECT order_id, floor(100 * sum(late) / count(*)) / 100 AS s FROM order_lines GROUP BY 1),
v AS (SELECT order_id::VARCHAR AS order_id, s, CASE WHEN s < 0.3333 THEN 'LOW' WHEN s < 0.6667 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM l)"""


@query(f"{_LEVELS} SELECT level, count(*) AS n, true AS c1, true AS c2, true AS c3, true AS c4, true AS c5, true AS c6, true AS c7, true AS c8 FROM v GROUP BY 1")
def chain_checks_c1_c8(spark: SparkSession, sf: str) -> DataFrame:
    """Every head passes all checks: counted by level."""
    rows = chain.with_checks(chains(spark, sf).withColumn("expected_id", F.col("order_id")))
    return rows.groupBy("level").agg(F.count("*").alias("n"), *[F.bool_and(c).alias(c) for c in chain.CHECKS])


@query(f"{_LEVELS} SELECT order_id, level, CASE level WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 6 ELSE 8 END AS checks, CASE level WHEN 'HIGH' THEN 3 ELSE 1 END AS validators FROM v")
def adaptive_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains(spark, sf).select("order_id", chain.adaptive_level(F.element_at("chain", -1), F.col("order_id")).alias("level"))
    value = lambda i: F.when(F.col("level") == "LOW", chain.BANDS["LOW"][i]).when(F.col("level") == "HIGH", chain.BANDS["HIGH"][i]).otherwise(chain.BANDS["MEDIUM"][i])
    return rows.select("order_id", "level", value(0).alias("checks"), value(1).alias("validators"))


@query(f"""{_LEVELS}, p AS (SELECT 'B0' AS policy, 4 AS c, 1 AS q, level FROM v UNION ALL SELECT 'B1', 8, 3, level FROM v
UNION ALL SELECT 'P', CASE level WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 6 ELSE 8 END, CASE level WHEN 'HIGH' THEN 3 ELSE 1 END, level FROM v)
SELECT policy, count(*) AS orders, sum(c)::BIGINT AS checks, sum(q)::BIGINT AS validators, sum(c * q)::BIGINT AS runs FROM p GROUP BY 1""")
def policy_op_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains(spark, sf).select(chain.adaptive_level(F.element_at("chain", -1), F.col("order_id")).alias("level"))
    return chain.operation_counts(rows)


@query(f"{_LEVELS}, d AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS band) SELECT band, count(v.level) AS n FROM d LEFT JOIN v ON level = band GROUP BY 1")
def risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    counts = chains(spark, sf).groupBy(F.element_at("chain", -1).ai_risk_reference.risk_level.alias("band")).agg(F.count("*").alias("k"))
    every = spark.createDataFrame([(x,) for x in chain.LEVELS], "band string")
    return every.join(counts, "band", "left").select("band", F.coalesce("k", F.lit(0)).alias("n"))


@query("""
, s AS (SELECT order_id, round(discount_rate, 2) AS s, item_id::VARCHAR AS i FROM order_lines)
SELECT order_id, max(s) AS risk, count(*) AS n, sha256('[' || string_agg('"' || i || '"', ',' ORDER BY i) || ']') AS rows_digest FROM s GROUP BY 1
""")
def risk_max_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """The largest line score of each order, and a digest of its row ids in the order of their text."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), lambda x: json_string(x)), ",")
    return order_lines(spark, sf).groupBy("order_id").agg(
        F.max(F.round("discount_rate", 2)).alias("risk"), F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), ids, F.lit("]")), 256).alias("rows_digest")
    )


@query(f"{_HASHES} SELECT oid AS order_id, score AS risk_score, level AS risk_level, rd AS record_digest FROM h4")
def risk_record_digest(spark: SparkSession, sf: str) -> DataFrame:
    r = F.element_at("chain", -1).ai_risk_reference
    return chains(spark, sf).select("order_id", r.risk_score.alias("risk_score"), r.risk_level.alias("risk_level"), r.record_digest.alias("record_digest"))


def _hit(scenario: str, level: str) -> bool:
    """Whether the adaptive policy rejects: by the checks that the resolved band holds."""
    if scenario in ("PA-02", "PA-03", "PA-05", "PA-08", "PA-09"):
        low = {"PA-02", "PA-03"}
        return scenario in low or level != "LOW" or scenario in ("PA-08", "PA-09")
    return scenario == "PA-04" and level == "HIGH"


_VERDICTS = ", ".join(
    f"('{s}', '{v}', {str(s in ('PA-02', 'PA-03')).lower()}, {str(s not in ('PA-01', 'PA-07')).lower()}, {str(_hit(s, v)).lower()})" for s in chain.SCENARIOS for v in chain.LEVELS
)


@query(f"""{_LEVELS}, w AS (SELECT * FROM (VALUES {_VERDICTS}) t(scenario, level, b0, b1, p))
SELECT scenario, v.level AS band, count(*) AS n, count(*) FILTER (WHERE b0) AS hit_b0, count(*) FILTER (WHERE b1 AND NOT (scenario = 'PA-06' AND s >= 1)) AS hit_b1, count(*) FILTER (WHERE p) AS hit_p
FROM v JOIN w USING (level) GROUP BY ALL""")
def tamper_matrix_detection(spark: SparkSession, sf: str) -> DataFrame:
    """How many tampered heads each policy rejects."""
    rows = chains(spark, sf).withColumn("expected_id", F.col("order_id"))
    rows = rows.withColumn("band", F.element_at("chain", -1).ai_risk_reference.risk_level)
    out = chain.tamper(rows, *chain.SCENARIOS)
    hit = lambda p: F.count_if(~F.col(f"accepted_{p}")).alias(f"hit_{p.lower()}")
    return chain.verdicts(chain.with_checks(out)).groupBy("scenario", "band").agg(F.count("*").alias("n"), hit("B0"), hit("B1"), hit("P"))


_BYTES = "sum(strlen(t0) + strlen(t1) + strlen(t2) + strlen(t3) + strlen(t4))::BIGINT AS bytes"


@query(f"{_HASHES} SELECT count(*) AS orders, 5 * count(*) AS blocks, {_BYTES} FROM h4")
def storage_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the canonical blocks of all orders."""
    return chains(spark, sf).agg(F.count("*").alias("orders"), F.sum(F.size("chain")).alias("blocks"), F.sum(experiments.block_bytes()).alias("bytes"))


def _workload_sql() -> str:
    ranked = " UNION ALL ".join(
        f"""SELECT {s} AS seed, order_id, level, s, row_number() OVER (ORDER BY sha256('{{"order_id":"' || order_id || '","seed":{s}}}'), order_id) AS position FROM v"""
        for s in experiments.SEEDS
    )
    sizes = ", ".join(f"({s})" for s in experiments.SIZES)
    return f"{_LEVELS}, rk AS ({ranked}), wl AS (SELECT * FROM rk JOIN (VALUES {sizes}) z(workload) ON position <= workload)"


@query(f"""{_workload_sql()} SELECT seed, workload, count(*) FILTER (WHERE level = 'LOW') AS low, count(*) FILTER (WHERE level = 'MEDIUM') AS medium,
count(*) FILTER (WHERE level = 'HIGH') AS high FROM wl GROUP BY ALL""")
def workload_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.band_counts(experiments.workloads(chains(spark, sf)))


@query(f"""{_workload_sql()}, t AS (SELECT *, ('0x' || substr(sha256('{{"scenario":"PA-08","seed":' || seed || ',"workload":' || workload || '}}'), 57, 8))::BIGINT % workload = position - 1 AS hit FROM wl),
p AS (SELECT *, unnest(['B0', 'B1', 'P']) AS policy FROM t)
SELECT seed, workload, policy, count(*) FILTER (WHERE NOT hit) AS untouched, count(*) FILTER (WHERE NOT hit) AS untouched_accepted, count(*) FILTER (WHERE hit) AS tampered,
       count(*) FILTER (WHERE hit AND policy <> 'B0') AS tampered_rejected FROM p GROUP BY ALL""")
def fault_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """One order of each workload has its chain re-keyed: the others stay accepted under every policy."""
    return experiments.isolation(experiments.attacked(experiments.workloads(chains(spark, sf)), "PA-08"))


_SPENT = "unnest([{{'policy': 'B0', 'c': 4, 'v': 1}}, {{'policy': 'B1', 'c': 8, 'v': 3}}, {{'policy': 'P', 'c': {c}, 'v': {v}}}])".format(
    c="CASE level WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 6 ELSE 8 END", v="CASE level WHEN 'HIGH' THEN 3 ELSE 1 END"
)


@query(f"""{_workload_sql()}, u AS (SELECT seed, workload, {_SPENT} AS x FROM wl)
SELECT seed, workload, x.policy AS policy, count(*) AS orders, count(*) AS accepted, 0::BIGINT AS rejected, count(*) AS constructed,
{", ".join(f"count(*) FILTER (WHERE x.c >= {i}) AS n_c{i}" for i in range(1, 9))} FROM u GROUP BY ALL""")
def functional_correctness(spark: SparkSession, sf: str) -> DataFrame:
    """Clean chains: every policy accepts all of them, and applies the checks of its band."""
    return experiments.functional(experiments.workloads(chains(spark, sf)))


#: where each scenario leaves its evidence in a chain of five blocks
_PLACES = {"PA-02": "block 1", "PA-03": "block 2", "PA-05": "genesis", "PA-08": "chain"}
_PLACE_SQL = "CASE scenario " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLACES.items()) + " ELSE 'head' END"


@query(f"""{_workload_sql()}, w AS (SELECT * FROM (VALUES {_VERDICTS}) t(scenario, level, b0, b1, p)),
t AS (SELECT * FROM wl JOIN w USING (level) WHERE position - 1 = ('0x' || substr(sha256('{{"scenario":"' || scenario || '","seed":' || seed || ',"workload":' || workload || '}}'), 57, 8))::BIGINT % workload),
x AS (SELECT *, unnest([{{'policy': 'B0', 'hit': b0}}, {{'policy': 'B1', 'hit': b1 AND NOT (scenario = 'PA-06' AND s >= 1)}}, {{'policy': 'P', 'hit': p}}]) AS j FROM t)
SELECT seed, workload, scenario, j.policy AS policy, order_id, j.hit AS detected, j.hit AS localized, CASE WHEN j.hit THEN {_PLACE_SQL} ELSE 'undetected' END AS location FROM x""")
def tamper_localization(spark: SparkSession, sf: str) -> DataFrame:
    """One order of each workload and scenario is tampered with: which policies find it, and where."""
    return experiments.localization(experiments.workloads(chains(spark, sf)))


@query(f"""{_workload_sql()}, u AS (SELECT seed, workload, level, {_SPENT} AS x FROM wl)
SELECT seed, workload, level, x.policy AS policy, count(*) AS orders, sum(x.c)::BIGINT AS checks, sum(x.v)::BIGINT AS validators FROM u GROUP BY ALL""")
def adaptive_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.allocation(experiments.workloads(chains(spark, sf)))

