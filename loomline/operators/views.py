"""The denormalised order-line table over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its order, customer, geography and product.

    Columns that a query does not use are pruned down to the scans.
    """
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return _named(rows)


def order_lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`order_lines`, the order last: what is grouped by order needs no further shuffle."""
    t = lambda n: table(spark, sf_dir, n)
    orders = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    parts = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return _named(parts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def _named(rows: DataFrame) -> DataFrame:
    scheduled = F.substring("o_orderpriority", 1, 1).cast("int")
    return rows.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("l_shipdate").alias("ship_ts"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("total"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        F.col("p_retailprice").alias("product_price"),
        F.col("l_discount").alias("discount_rate"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        F.col("o_orderpriority").alias("type"),
        F.col("r_name").alias("market"),
        F.col("c_mktsegment").alias("segment"),
        F.col("l_returnflag").alias("shipping_mode"),
        F.col("p_brand").alias("department"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("l_linestatus").alias("delivery_status"),
        scheduled.alias("days_scheduled"),
        (F.datediff("l_shipdate", "o_orderdate") > scheduled).cast("int").alias("late"),
    )


ORDER_LINES_SQL = """
order_lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_orderkey * 8 + l_linenumber AS item_id,
         o_custkey AS customer_id, l_partkey AS product_id, o_orderdate AS order_ts, l_shipdate AS ship_ts,
         l_quantity AS quantity, l_extendedprice AS total,
         CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price,
         p_retailprice AS product_price, l_discount AS discount_rate, l_extendedprice * l_discount AS discount,
         o_orderpriority AS type, r_name AS market, c_mktsegment AS segment, l_returnflag AS shipping_mode,
         p_brand AS department, o_orderstatus AS order_status, l_linestatus AS delivery_status,
         substr(o_orderpriority, 1, 1)::INT AS days_scheduled,
         (date_diff('day', o_orderdate, l_shipdate) > substr(o_orderpriority, 1, 1)::INT)::INT AS late
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
)
"""
