"""Tables from files: fixed and inferred CSV, discovery by signature, splits, JSON cells, synthetic rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_number, stable_hash, to_timestamp_or_null

__all__ = [
    "RAW_SCHEMA", "Ambiguous", "dev_scope", "find_candidates", "header", "json_cells", "load_config", "load_or_generate", "normalize", "observations",
    "read_csv", "read_orders_csv", "read_splits", "resolve", "synthetic_transactions", "with_row_id",
]

#: The canonical transaction table.
RAW_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("transaction_id", "participant_id", "product_id", "order_id")]
    + [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in ("quantity", "unit_price", "total_amount")]
    + [T.StructField("location_region", T.StringType()), T.StructField("transaction_status", T.StringType()), T.StructField("shipping_days", T.DoubleType())]
)


class Ambiguous(ValueError):
    """More than one file qualifies; none is chosen."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings, which costs no extra pass."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """The canonical table: all its columns must be there, others stay; no row is an error."""
    raw = read_csv(spark, path)
    if missing := [f.name for f in RAW_SCHEMA if f.name not in raw.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    out = {}
    for f in RAW_SCHEMA:
        kind = f.dataType.simpleString()
        out[f.name] = F.col(f.name).try_cast(kind) if kind != "double" else as_number(f.name)
    df = raw.withColumns(out)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """The column names of a CSV file; only its first line is parsed."""
    return spark.read.option("header", True).option("encoding", encoding).csv(path).columns


def _list(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> list[str]:
    """Files in a folder of any store that Spark reads, by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted(n for n in names if n.lower().endswith(tuple(suffixes)))


def find_candidates(spark: SparkSession, folder: str, signature: Sequence[str], encoding: str = "ISO-8859-1") -> list[str]:
    """The CSV files whose header holds all columns of the signature."""
    return [p for p in _list(spark, folder, [".csv"]) if set(signature) <= set(header(spark, p, encoding))]


def resolve(spark: SparkSession, folders: Sequence[str], signature: Sequence[str]) -> str | None:
    """The one qualifying file of the first folder that has any; several are ambiguous and refused."""
    for folder in folders:
        found = find_candidates(spark, folder, signature)
        if len(found) > 1:
            raise Ambiguous(f"{len(found)} files qualify in {folder}")
        if found:
            return found[0]
    return None


def with_row_id(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``row_id`` from 0 in a total order, numbered in ranges: no task sees all rows.

    The ranges come from the range partitioning of the order, and their counts are one row
    a partition.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    rows = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    up = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__s"))
    return rows.join(starts, "__p").withColumn("row_id", F.col("__s") + F.col("__i") - 1).drop("__p", "__i", "__s", "__n")


def normalize(raw: DataFrame, names: dict[str, str], label: str | None = None) -> DataFrame:
    """Rename raw columns to the canonical ones and cast: ids to text, numbers or null, times or null.

    Rows without id, order or time go. ``names`` maps canonical to raw names.
    """
    out = []
    for f in RAW_SCHEMA:
        c = F.col(f"`{names[f.name]}`")
        kind = f.dataType.simpleString()
        out.append((as_number(c) if kind == "double" else to_timestamp_or_null(c) if kind == "timestamp" else c.cast("string")).alias(f.name))
    if label:
        out.append(F.col(f"`{label}`").try_cast("long").alias("natural_label"))
    return raw.select(*out).na.drop(subset=["transaction_id", "order_id", "timestamp"])


def read_splits(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Only the folders of the requested splits are read."""
    return spark.read.parquet(path).filter(F.col("split").isin(list(names)))


def dev_scope(spark: SparkSession, path: str) -> DataFrame:
    """Training and validation rows; the test split is never read."""
    return read_splits(spark, path, ["train", "validation"])


def json_cells(spark: SparkSession, folder: str, records: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one row for each entry of their array ``records``."""
    cells = spark.read.option("multiLine", True).schema(schema).json(folder)
    return cells.select(*[c for c in cells.columns if c != records], F.inline(records))


def observations(spark: SparkSession, path: str, schema: T.StructType, expected: str | None = None) -> DataFrame:
    """CSV fact rows; with an expected fingerprint a difference is an error."""
    from .writers import fingerprint

    df = read_csv(spark, path, schema)
    if expected is not None and (found := fingerprint(df)) != expected:
        raise ValueError(f"fingerprint {found}, expected {expected}")
    return df


def load_config(text: str) -> dict:
    """A configuration from JSON, or from YAML where a parser is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed; give JSON") from e
        return yaml.safe_load(text)


def _u(seed: int, name: str) -> Column:
    """A uniform draw for the row ``id``, from a digest."""
    return F.conv(F.substring(stable_hash(F.lit(seed), F.lit(name), F.col("id")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def synthetic_transactions(spark: SparkSession, n: int, seed: int = 42, anomaly_fraction: float = 0.03) -> DataFrame:
    """n canonical transactions with known anomalies: of quantity, price or delay. Every value is a function of seed and row."""
    kind = F.when(_u(seed, "a") < anomaly_fraction, F.floor(_u(seed, "k") * 3).cast("int") + 1).otherwise(0)
    rows = spark.range(n).withColumn("known_anomaly", kind)
    level = lambda name, items: F.element_at(F.array(*[F.lit(x) for x in items]), F.floor(_u(seed, name) * len(items)).cast("int") + 1)
    a = F.col("known_anomaly")
    quantity = (F.floor(_u(seed, "q") * 20) + 1) * F.when(a == 1, level("qf", [3.0, 5.0, 8.0, 12.0])).otherwise(1.0)
    price = F.round((5 + 195 * _u(seed, "p")) * F.when(a == 2, level("pf", [1.5, 2.0, 3.0])).otherwise(1.0), 2)
    days = F.when(a == 3, F.round(25 + 35 * _u(seed, "d"), 1)).otherwise(F.round(1 + 9 * _u(seed, "d"), 1))
    return rows.select(
        F.format_string("TXN-%06d", "id").alias("transaction_id"),
        F.format_string("PART-%03d", F.floor(_u(seed, "pa") * 40).cast("int")).alias("participant_id"),
        F.format_string("PROD-%03d", F.floor(_u(seed, "pr") * 60).cast("int")).alias("product_id"),
        F.format_string("ORD-%06d", F.floor(F.col("id") / 3).cast("long")).alias("order_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("timestamp"),
        quantity.alias("quantity"), price.alias("unit_price"), F.round(quantity * price, 2).alias("total_amount"),
        level("r", ["North", "South", "East", "West"]).alias("location_region"), level("s", ["COMPLETE", "PENDING", "PROCESSING"]).alias("transaction_status"),
        days.alias("shipping_days"), a.alias("known_anomaly"), anomaly_name(a).alias("anomaly_type"),
    )


def anomaly_name(code: Column) -> Column:
    return F.when(code == 1, "quantity").when(code == 2, "price").when(code == 3, "delay").otherwise("none")


def load_or_generate(spark: SparkSession, folders: Sequence[str], signature: Sequence[str], n: int, source: str = "auto") -> DataFrame:
    """Local files first, else synthetic rows. There is no remote source here."""
    if source in ("auto", "local"):
        if path := resolve(spark, folders, signature):
            return read_orders_csv(spark, path)
        if source == "local":
            raise FileNotFoundError("no file qualifies")
    if source not in ("auto", "synthetic"):
        raise ValueError(f"no source {source}")
    return synthetic_transactions(spark, n)
