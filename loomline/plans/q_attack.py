"""Tampering: manifest, attacked rows, restore, ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attack
from ..session import table
from .registry import query

FIELDS = ("quantity", "total", "order_status", "order_ts")


def subject(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order: a unique key and a field of each kind."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id_"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 50).cast("double").alias("quantity"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_ts"), F.col("o_orderpriority").alias("market"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("days_scheduled"),
    )


def manifest(spark: SparkSession, sf: str, name: str = "value_manipulation") -> DataFrame:
    return attack.attack_manifest(subject(spark, sf), "record_id_", attack.SCENARIOS[name], "MEDIUM", 0.05)


_TAKEN = """
d AS (SELECT o_orderkey AS id, {cols}, sha256('42|{name}|' || o_orderkey) AS h FROM orders WHERE {where}),
r AS (SELECT *, row_number() OVER (ORDER BY h, id) AS p, count(*) OVER () AS n FROM d),
m AS (SELECT * FROM r WHERE p <= least(n, greatest(1, round_even(n * 0.05, 0)::BIGINT)))
"""
_VALUE = _TAKEN.format(name="value_manipulation", cols="o_totalprice AS total", where="o_totalprice > 0")
_F = "CASE WHEN ('0x' || right(h, 1))::INT % 2 = 0 THEN 0.7::DOUBLE ELSE 1.35::DOUBLE END"


@query(f"WITH {_VALUE} SELECT id AS record_id, 'total' AS original_field, round(total, 6) AS original, round(total * {_F}, 6) AS modified FROM m")
def attack_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(manifest(spark, sf))


_STATUS = _TAKEN.format(name="transaction_status_manipulation", cols="o_orderstatus AS s", where="o_orderstatus IS NOT NULL")


@query(f"""
WITH {_STATUS}, l AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS ls FROM orders),
x AS (SELECT id, s, ls[(list_position(ls, s) - 1 + 2) % len(ls) + 1] AS t, ls[(list_position(ls, s) - 1 + 1) % len(ls) + 1] AS u FROM m, l)
SELECT id AS record_id, s AS original_value, CASE WHEN t = s THEN u ELSE t END AS modified_value FROM x
""")
def attack_manifest_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf, "transaction_status_manipulation").select("record_id", "original_value", "modified_value")


_TIME = _TAKEN.format(name="timestamp_manipulation", cols="o_orderdate AS t", where="o_orderdate IS NOT NULL")


@query(f"""
WITH {_TIME} SELECT id AS record_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS original_value,
strftime(t + CASE WHEN ('0x' || right(h, 1))::INT % 2 = 0 THEN INTERVAL (-24) HOUR ELSE INTERVAL 24 HOUR END, '%Y-%m-%d %H:%M:%S') AS modified_value FROM m
""")
def attack_manifest_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf, "timestamp_manipulation").select("record_id", "original_value", "modified_value")


_QUANTITY = _TAKEN.format(name="quantity_manipulation", cols="(o_custkey % 50)::DOUBLE AS q", where="o_custkey % 50 > 0")


def _numbers(rows: DataFrame) -> DataFrame:
    number = lambda c, n: F.round(F.col(c).cast("double"), 6).alias(n)
    return rows.select("record_id", "original_field", number("original_value", "original"), number("modified_value", "modified"))


@query(f"""
WITH {_QUANTITY} SELECT id AS record_id, 'quantity' AS original_field, q AS original,
round(q * CASE WHEN ('0x' || right(h, 1))::INT % 2 = 0 THEN 0.6::DOUBLE ELSE 1.5::DOUBLE END, 6) AS modified FROM m
""")
def attack_manifest_quantity(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(manifest(spark, sf, "quantity_manipulation"))


_DAYS = _TAKEN.format(name="shipping_delivery_manipulation", cols="substr(o_orderpriority, 1, 1)::DOUBLE AS d", where="o_orderpriority IS NOT NULL")


@query(f"""
WITH {_DAYS}, x AS (SELECT *, greatest(d + CASE WHEN ('0x' || right(h, 1))::INT % 2 = 0 THEN -3 ELSE 3 END, 0) AS moved FROM m)
SELECT id AS record_id, 'days_scheduled' AS original_field, d AS original, CASE WHEN moved = d THEN d + 3 ELSE moved END AS modified FROM x
""")
def attack_manifest_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(manifest(spark, sf, "shipping_delivery_manipulation"))


_ROUTE = _TAKEN.format(name="geographic_route_manipulation", cols="o_orderpriority AS s", where="o_orderpriority IS NOT NULL")


@query(f"""
WITH {_ROUTE}, l AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ls FROM orders),
x AS (SELECT id, s, ls[(list_position(ls, s) - 1 + 2) % len(ls) + 1] AS t, ls[(list_position(ls, s) - 1 + 1) % len(ls) + 1] AS u FROM m, l)
SELECT id AS record_id, s AS original_value, CASE WHEN t = s THEN u ELSE t END AS modified_value FROM x
""")
def attack_manifest_route(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf, "geographic_route_manipulation").select("record_id", "original_value", "modified_value")


_RECORD = _TAKEN.format(name="transaction_record_tampering", cols="(o_custkey % 50)::DOUBLE AS q, o_totalprice AS t", where="o_custkey % 50 > 0 OR o_totalprice > 0")


@query(f"""
WITH {_RECORD}, b AS (SELECT *, ('0x' || right(h, 1))::INT AS bit FROM m),
x AS (SELECT *, CASE WHEN bit % 2 = 0 THEN 0.6::DOUBLE ELSE 1.5::DOUBLE END AS f, NOT q > 0 OR (t > 0 AND bit // 2 % 2 = 1) AS on_total FROM b)
SELECT id AS record_id, CASE WHEN on_total THEN 'total' ELSE 'quantity' END AS original_field,
round(CASE WHEN on_total THEN t ELSE q END, 6) AS original, round(f * CASE WHEN on_total THEN t ELSE q END, 6) AS modified FROM x
""")
def attack_manifest_record(spark: SparkSession, sf: str) -> DataFrame:
    """Of two fields, the digest names the one that changes; a row with one usable field changes there."""
    return _numbers(manifest(spark, sf, "transaction_record_tampering"))


@query(f"""
WITH {_VALUE} SELECT o_orderkey AS record_id, round(CASE WHEN m.id IS NULL THEN o_totalprice ELSE o_totalprice * {_F} END, 6) AS total
FROM orders LEFT JOIN m ON o_orderkey = m.id
""")
def attacked_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = attack.apply_manifest(subject(spark, sf), manifest(spark, sf), "record_id_", FIELDS)
    return rows.select(F.col("record_id_").alias("record_id"), F.round("total", 6).alias("total"))


@query("SELECT o_orderkey AS record_id, round(o_totalprice, 6) AS total, o_orderstatus AS order_status FROM orders")
def restore_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    attacked = attack.apply_manifest(subject(spark, sf), m, "record_id_", FIELDS)
    rows = attack.restore(attacked, m, "record_id_", FIELDS)
    return rows.select(F.col("record_id_").alias("record_id"), F.round("total", 6).alias("total"), "order_status")


@query(f"""
WITH {_VALUE} SELECT o_orderkey AS record_id, (m.id IS NOT NULL)::INT AS is_attack, CASE WHEN m.id IS NOT NULL THEN 'value_manipulation' END AS attack_type,
CASE WHEN m.id IS NOT NULL THEN 'MEDIUM' END AS attack_severity, CASE WHEN m.id IS NOT NULL THEN 'total' END AS original_field FROM orders LEFT JOIN m ON o_orderkey = m.id
""")
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    return attack.ground_truth(subject(spark, sf), manifest(spark, sf), "record_id_")


@query("""
WITH s AS (SELECT unnest(['geographic_route_manipulation', 'quantity_manipulation', 'shipping_delivery_manipulation', 'timestamp_manipulation',
'transaction_record_tampering', 'transaction_status_manipulation', 'value_manipulation']) AS attack_type),
c AS (SELECT attack_type, unnest([0.01, 0.03, 0.05, 0.1])::DOUBLE AS rate, 'MEDIUM' AS severity FROM s
UNION SELECT attack_type, 0.05::DOUBLE, unnest(['LOW', 'MEDIUM', 'HIGH']) FROM s) SELECT * FROM c
""")
def experiment_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(attack.sweep(), "attack_type string, rate double, severity string")
