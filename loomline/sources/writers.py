"""Writers: CSV, split Parquet, JSON reports, data dictionary, resumable cells, fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["data_dictionary", "fingerprint", "json_report", "missing_cells", "row_digest", "run_missing", "sums", "write_csv", "write_splits"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet in a folder for each split, so that readers of one split list only its files."""
    df.write.partitionBy("split").mode("overwrite").parquet(path)


def json_report(values: dict, df: DataFrame) -> str:
    """A report as canonical JSON with Spark's version: keys sorted, no NaN."""
    return json.dumps({"spark": df.sparkSession.version, **values}, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the values as text; null is told from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("∅")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows as a multiset and of the column names: row order does not matter.

    Digests of rows are gathered per leading digits, so no task holds those of all rows.
    """
    columns = sorted(df.columns)
    rows = df.select(row_digest(columns).alias("d"))
    per = rows.groupBy("d").agg(F.count("*").alias("n")).groupBy(F.substring("d", 1, 3).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "d", "n"))), ","), 256).alias("d")
    )
    all_ = per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x.d), ",").alias("x"))
    return all_.select(F.sha2(F.concat_ws("|", F.lit(",".join(columns)), F.coalesce("x", F.lit(""))), 256)).first()[0]


def sums(df: DataFrame) -> str:
    """A digest of the rows as a multiset and of the column names, from the number of rows and sums of
    two 64-bit hashes of each: one pass without a shuffle of rows, for large tables that a run wrote itself.
    It tells changes, not forgeries; for these there is :func:`fingerprint`."""
    columns = sorted(df.columns)
    at = [x for i, c in enumerate(columns) for x in (F.col(c), F.lit(i))]  # a null leaves its place to be seen
    hashes = [F.xxhash64(F.lit(seed), *at) for seed in (1, 2)]
    parts = [F.shiftrightunsigned(h, 22 * k).bitwiseAND(2**22 - 1) for h in hashes for k in range(3)]
    row = df.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in parts]).first()
    return hashlib.sha256("|".join([",".join(columns), *map(str, row)]).encode()).hexdigest()


def missing_cells(plan: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """The cells of a plan that have no result yet."""
    return plan.join(done.select(*key).distinct(), list(key), "left_anti")


def run_missing(plan: DataFrame, path: str, key: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the cells that ``path`` does not hold and append their results; Spark's committer writes all or nothing."""
    spark = plan.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        plan = missing_cells(plan, spark.read.parquet(path), key)
    run(plan).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def data_dictionary(df: DataFrame) -> str:
    """A Markdown table of the columns: type, role, nulls, distinct values."""
    from ..operators.quality import column_roles, null_profile

    roles, kinds = dict(column_roles(df)), dict(df.dtypes)
    rows = {r["column_name"]: r for r in null_profile(df).collect()}
    lines = ["| column | type | role | nulls | distinct |", "|---|---|---|---|---|"]
    lines += [f"| {c} | {kinds[c]} | {roles[c]} | {rows[c]['n_null']} | {rows[c]['n_distinct']} |" for c in df.columns]
    return "\n".join(lines) + "\n"
