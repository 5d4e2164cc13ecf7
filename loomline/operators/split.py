"""Splits without leakage, their overlap and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_index, stable_hash
from . import ranks

SPLITS = ("train", "validation", "test")


def hash_split(df: DataFrame, group: str | Column, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split``: rows of a group always fall together, by a hash of group and seed. No shuffle."""
    g = F.col(group) if isinstance(group, str) else group
    u = hash_index(stable_hash(F.lit(seed), g), 10_000)
    a, b = round(ratios[0] * 10_000), round((ratios[0] + ratios[1]) * 10_000)
    return df.withColumn("split", F.when(u < a, SPLITS[0]).when(u < b, SPLITS[1]).otherwise(SPLITS[2]))


def greedy_group_split(df: DataFrame, group: str, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split``: groups in hashed order fill train, then validation, then test.

    A group goes where its first row falls, so a split overshoots by one group at most. The
    running sums are over a table with one row a group, in two levels.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__h", stable_hash(F.lit(seed), F.col(group)))
    sizes = sizes.withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    per = sizes.groupBy("__b").agg(F.sum("__n").alias("__s"))
    up = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("__b", F.coalesce(F.sum("__s").over(up), F.lit(0)).alias("__start"), F.sum("__s").over(Window.partitionBy()).alias("__total"))
    inside = Window.partitionBy("__b").orderBy("__h", group).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, "__b")
    at = (F.col("__start") + F.col("__in")) / F.col("__total")
    named = before.select(
        group, F.when(at < ratios[0], SPLITS[0]).when(at < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]).alias("split")
    )
    return df.join(named, group)


def chronological_split(df: DataFrame, time: str, ratios: Sequence[float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """Add ``split`` by time: cut points are counts rounded half to even.

    Whole instants stay together: an instant goes where its first row falls. Counts per
    instant are summed up in two levels instead of numbering all rows in one task. Rows
    without a time are left out.
    """
    a, b = F.bround(F.col("total") * ratios[0]), F.bround(F.col("total") * (ratios[0] + ratios[1]))
    name = F.when(F.col("before") < a, SPLITS[0]).when(F.col("before") < b, SPLITS[1]).otherwise(SPLITS[2])
    return df.join(ranks.counted(df, time).select(time, name.alias("split")), time)


def identity_overlap(df: DataFrame, key: str) -> DataFrame:
    """(split_a, split_b, n_shared): keys that two splits have in common. One row a key, no self-join."""
    sets = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.collect_set("split").alias("s"))
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    row = sets.agg(
        *[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)]
    )
    items = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"v{i}").alias("n_shared")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*items)))


def target_balance(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(target) == 1).alias("n_positive"),
        F.round(F.avg((F.col(target) == 1).cast("double")), 6).alias("rate"),
    )


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that come first by a hash of key and seed: the same at every run."""
    return df.orderBy(stable_hash(F.lit(seed), F.col(key)), key).limit(n)
