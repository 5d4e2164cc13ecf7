"""Features that are fitted on the training split and applied to all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_category
from . import ranks

OTHER = "__OTHER__"


def order_aggregates(train: DataFrame, key: str = "order_id", total: str = "total") -> DataFrame:
    return train.groupBy(key).agg(F.count("*").alias("order_item_count"), F.sum(total).alias("order_total_value"))


def append_order_level(df: DataFrame, aggregates: DataFrame, key: str = "order_id") -> DataFrame:
    """Left lookup of the order's values; orders that were not seen in training get null.

    The aggregates have a row an order, so they grow with the data: the planner broadcasts
    them only below its threshold and else joins by a shuffle on the key that both share.
    """
    return df.join(aggregates, key, "left")


def group_mean_ratio(df: DataFrame, value: str, group: str) -> DataFrame:
    """Add ``ratio``: value over its group's mean. The mean is aggregated before the join, so a
    hot group costs no more than another."""
    means = df.groupBy(group).agg(F.avg(value).alias("__mean"))
    return df.join(means, group).withColumn("ratio", F.try_divide(F.col(value), F.col("__mean"))).drop("__mean")


def basic_features(df: DataFrame, keys: Sequence[str], base: Sequence[str], total: str, quantity: str, time: str, product: str) -> DataFrame:
    """The keys, ``base`` and amount_per_unit, log_total, hour, day_of_week, is_weekend, quantity_ratio, as doubles.

    Rows of which fewer than half of the values are present go, then columns that still lack one.
    A product's mean is over all rows with a quantity; a row without a product has no ratio.
    """
    means = df.groupBy(F.col(product).alias("__p")).agg(F.avg(F.col(quantity).cast("double")).alias("__mean"))
    weekday = F.weekday(time)
    named = {
        **{c: F.col(c).cast("double") for c in base}, "amount_per_unit": F.try_divide(F.col(total).cast("double"), F.col(quantity).cast("double")),
        "log_total": F.log1p(F.col(total).cast("double")), "hour": F.hour(time).cast("double"), "day_of_week": weekday.cast("double"),
        "is_weekend": F.coalesce(weekday >= 5, F.lit(False)).cast("double"), "quantity_ratio": F.try_divide(F.col(quantity).cast("double"), F.col("__mean")),
    }
    rows = df.join(means, F.col(product) == F.col("__p"), "left").select(*keys, *[v.alias(k) for k, v in named.items()])
    present = F.lit(0)
    for c in named:
        present += F.col(c).isNotNull().cast("int")
    rows = rows.filter(present >= max(1, len(named) // 2))
    holes = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in named]).first()  # one row
    return rows.select(*keys, *[c for c in named if not holes[c]])


def top_levels(train: DataFrame, columns: Sequence[str], k: int = 15, count: str | None = None) -> DataFrame:
    """(column_name, level, n, level_rank): the k most frequent levels, ties by level. ``count`` says how many rows a row stands for."""
    times = F.lit(1).cast("long") if count is None else F.col(count)
    long = train.select(times.alias("__t"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), clean_category(c).alias("level")) for c in columns])))
    counts = long.groupBy("column_name", "level").agg((F.count("*") if count is None else F.sum("__t")).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "level")
    return counts.withColumn("level_rank", F.row_number().over(w)).filter(F.col("level_rank") <= k)


def fitted_levels(train: DataFrame, columns: Sequence[str], k: int = 15) -> dict[str, list[str]]:
    """At most k levels a column, on the driver; sorted so that columns keep their order."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in top_levels(train, columns, k).collect():
        found[r["column_name"]].append(r["level"])
    return {c: sorted(v) for c, v in found.items()}


def with_other(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Levels that were not fitted become the other level."""
    for c, known in levels.items():
        clean = clean_category(c)
        df = df.withColumn(c, F.when(clean.isin(known), clean).otherwise(OTHER))
    return df


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Add a 0/1 double for each fitted level and for the other level."""
    added = {}
    for c, known in levels.items():
        clean = clean_category(c)
        for level in known:
            added[f"{c}={level}"] = F.when(clean == level, 1.0).otherwise(0.0)
        added[f"{c}={OTHER}"] = F.when(clean.isin(known), 0.0).otherwise(1.0)
    return df.withColumns(added)


def mask_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median, mean and population deviation of the imputed values of each column."""
    long = train.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])))
    found = ranks.quantiles(long, "v", [0.5], ["m"], ["c"])  # a row a column
    medians = found.agg(*[F.max(F.when(F.col("c") == i, F.col("m"))).alias(f"med_{c}") for i, c in enumerate(columns)])
    imputed = train.join(F.broadcast(medians)).select(  # one row
        *[F.coalesce(F.col(c), F.col(f"med_{c}")).alias(c) for c in columns], *[f"med_{c}" for c in columns]
    )
    return imputed.agg(
        *[F.first(f"med_{c}").alias(f"med_{c}") for c in columns],
        *[F.avg(c).alias(f"mu_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns],
    )


def scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Impute by the median and standardise; a deviation of 0 divides by 1. ``stats`` has one row."""
    joined = df.join(F.broadcast(stats))
    out = {}
    for c in columns:
        sd = F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0)
        out[c] = (F.coalesce(F.col(c), F.col(f"med_{c}")) - F.col(f"mu_{c}")) / sd
    return joined.withColumns(out).select(df.columns)


def fit_affine(rows: DataFrame, raw: str, processed: str) -> DataFrame:
    """One row (slope, intercept) of the least squares line from raw to processed values."""
    fitted = rows.filter(F.col(raw).isNotNull() & F.col(processed).isNotNull())
    return fitted.agg(F.regr_slope(processed, raw).alias("slope"), F.regr_intercept(processed, raw).alias("intercept"))


def apply_affine(df: DataFrame, line: DataFrame, raw: str, processed: str, changed: str) -> DataFrame:
    """Rewrite ``processed`` from ``raw`` in the rows where ``changed`` holds; an undefined line fails."""
    rows = df.join(F.broadcast(line))
    slope = F.coalesce("slope", F.raise_error(F.lit("no line: constant or too few values")).cast("double"))
    return rows.withColumn(
        processed, F.when(F.col(changed), slope * F.col(raw) + F.col("intercept")).otherwise(F.col(processed))
    ).select(df.columns)
