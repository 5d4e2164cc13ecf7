"""Cleaning, quality checks, profiles and leakage rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def drop_sparse_rows(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Keep rows with at least ``int(threshold * columns)`` values that are not null."""
    return df.na.drop(thresh=int(threshold * len(columns)), subset=list(columns))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def forward_fill(df: DataFrame, order: str, columns: Sequence[str], span: int = 65_536) -> DataFrame:
    """Replace nulls by the last value before, in the order of an integer column.

    The order is cut into spans. Each span fills itself and learns the last value of all
    earlier spans from a table with one row a span, so rows are spread over tasks although
    the order is global.
    """
    rows = df.withColumn("__span", F.floor(F.col(order) / span))
    lasts = rows.groupBy("__span").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__l_{c}") for c in columns]
    )
    earlier = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__span", *[F.last(f"__l_{c}", True).over(earlier).alias(f"__c_{c}") for c in columns])
    inside = Window.partitionBy("__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carried, "__span", "left")
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.last(c, True).over(inside), F.col(f"__c_{c}")))
    return filled.select(df.columns)


def clean(df: DataFrame, key: str, order: Sequence[str], positive: Sequence[str], timestamp: str) -> DataFrame:
    """First row of each key, positive measures, a valid time."""
    rows = first_per_key(df, [key], list(order))
    test = F.col(timestamp).isNotNull()
    for c in positive:
        test &= F.col(c) > 0
    return rows.filter(test)


def quality_counts(df: DataFrame, numeric: Sequence[str], times: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """(column_name, check_name, n): text that is no number or no time, and negative values. One pass."""
    aggs, labels = [], []
    for kind, columns in (("not_numeric", numeric), ("not_a_time", times), ("negative", negative)):
        for c in columns:
            if kind == "not_numeric":
                test = F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()
            elif kind == "not_a_time":
                test = F.col(c).isNotNull() & F.col(c).cast("string").try_cast("timestamp").isNull()
            else:
                test = F.col(c).cast("string").try_cast("double") < 0
            labels.append((c, kind))
            aggs.append(F.count_if(test).alias(f"v{len(aggs)}"))
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.col(f"v{i}").alias("n")) for i, (c, k) in enumerate(labels)]
    return row.select(F.inline(F.array(*items)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct, is_constant) in one pass; distinct counts skip nulls."""
    columns = list(columns or df.columns)
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)],
        *[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    items = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"k{i}")).alias("n_null"),
            F.col(f"d{i}").alias("n_distinct"),
            (F.col(f"d{i}") <= 1).alias("is_constant"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*items)))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (linear) and maximum of each column, on long rows."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])))
    names = ["q1", "median", "q3"]
    rows = ranks.with_quantiles(long.groupBy("column_name").agg(*describe("v")), ranks.quantiles(long, "v", [0.25, 0.5, 0.75], names, ["column_name"]), ["column_name"])
    return rows.withColumns({n: F.round(n, 4) for n in names})


def describe(v: str, digits: int = 4) -> list[Column]:
    return [
        F.count(v).alias("n"),
        F.round(F.avg(v), digits).alias("mean"),
        F.round(F.stddev_samp(v), digits).alias("sd"),
        F.round(F.min(v), digits).alias("min"),
        F.round(F.max(v), digits).alias("max"),
    ]


def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value of each column (of ties the smallest) and its count; nulls do not count."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.filter("value IS NOT NULL").groupBy("column_name", "value").count()
    best = counts.groupBy("column_name").agg(F.max(F.struct(F.col("count"), F.lit(0))).alias("m"))
    top = counts.join(best.select(F.col("column_name").alias("c"), F.col("m.count").alias("k")), (F.col("column_name") == F.col("c")) & (F.col("count") == F.col("k")))
    return top.groupBy("column_name").agg(F.min("value").alias("top_value"), F.max("count").alias("frequency"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct, n_duplicate): rows beyond the first of each identical tuple; null equals null."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.sum("__n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("__n") - 1).alias("n_duplicate")
    )


def key_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(n_keys, n_duplicate, n_repeated_keys, most): repeated null keys count as duplicates."""
    groups = df.groupBy(*key).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.count("*").alias("n_keys"),
        F.sum(F.col("__n") - 1).alias("n_duplicate"),
        F.count_if(F.col("__n") > 1).alias("n_repeated_keys"),
        F.max("__n").alias("most"),
    )


def value_counts(df: DataFrame, column: str, domain: Sequence[str] | None = None) -> DataFrame:
    """(value, n) including null; of a given domain every value, 0 where none occurs."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    known = df.sparkSession.createDataFrame([(x,) for x in domain], "value string")
    return known.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


ROLE_RULES = (
    ("identifier", ("id", "key")),
    ("datetime", ("date", "ts", "time")),
    ("outcome", ("status", "risk", "late")),
)


def column_roles(df: DataFrame) -> list[tuple[str, str]]:
    """(column, role) from name and type: identifier, datetime, outcome, numeric or categorical."""
    out = []
    for name, kind in df.dtypes:
        parts = name.lower().replace("_", " ").split()
        role = next((r for r, words in ROLE_RULES if any(w in parts or parts[-1].endswith(w) and len(w) > 2 for w in words)), None)
        if role is None:
            role = "datetime" if kind.startswith("timestamp") or kind == "date" else "categorical" if kind == "string" else "numeric"
        out.append((name, role))
    return out


def leakage_candidates(df: DataFrame, high_cardinality: float = 0.95) -> DataFrame:
    """(column_name, reason): outcomes and identifiers by name, and near-unique columns by count."""
    roles = dict(column_roles(df))
    profile = null_profile(df)
    by_role = df.sparkSession.createDataFrame(
        [(c, f"{r} column") for c, r in roles.items() if r in ("identifier", "outcome")], "column_name string, reason string"
    )
    unique = profile.filter(F.col("n_distinct") >= high_cardinality * F.col("n_rows")).select("column_name", F.lit("nearly unique").alias("reason"))
    return by_role.unionByName(unique)


def potential_datetime_columns(df: DataFrame, sample: int = 500, share: float = 0.9) -> list[str]:
    """Text columns named like dates of whose first values more than ``share`` are times."""
    names = [c for c, t in df.dtypes if t == "string" and "date" in c.lower()]
    if not names:
        return []
    row = df.select(*names).limit(sample).agg(
        *[F.avg(F.coalesce(F.try_to_timestamp(c, F.lit("M/d/yyyy H:m")), F.col(c).try_cast("timestamp")).isNotNull().cast("int")).alias(c) for c in names]
    ).first()
    return [c for c in names if (row[c] or 0) > share]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail closed if the frame carries identifiers, outcomes or attack columns."""
    if found := [c for c in columns if c in df.columns]:
        raise ValueError(f"columns are not allowed here: {', '.join(found)}")
    return df


def forbidden_fields(df: DataFrame, words: Sequence[str]) -> list[str]:
    """Paths of fields, nested ones too, whose names contain one of the words."""
    from pyspark.sql import types as T

    out: list[str] = []

    def walk(kind, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                at = f"{path}.{f.name}".lstrip(".")
                if any(w in f.name.lower() for w in words):
                    out.append(at)
                walk(f.dataType, at)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return out


def coverage(actual: DataFrame, plan: DataFrame, key: Sequence[str]) -> DataFrame:
    """(n_planned, n_missing, n_unplanned, n_repeated): whether rows cover a plan's cells exactly."""
    a = actual.groupBy(*key).agg(F.count("*").alias("__a"))
    p = plan.select(*key).distinct().withColumn("__p", F.lit(1))
    both = a.join(p, list(key), "full_outer")
    return both.agg(
        F.count("__p").alias("n_planned"),
        F.count_if(F.col("__a").isNull()).alias("n_missing"),
        F.count_if(F.col("__p").isNull()).alias("n_unplanned"),
        F.count_if(F.col("__a") > 1).alias("n_repeated"),
    )


def audit(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """(check_name, passed): named conditions that must hold in every row. One pass."""
    row = df.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(f"v{i}") for i, c in enumerate(checks.values())])
    items = [F.struct(F.lit(n).alias("check_name"), F.col(f"v{i}").alias("passed")) for i, n in enumerate(checks)]
    return row.select(F.inline(F.array(*items)))
