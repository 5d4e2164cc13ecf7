"""Reshaping: pivot, unpivot, zero-filled domains, set differences, experiment matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, by: Sequence[str], label: str, values: Sequence[str], value: Column) -> DataFrame:
    """A column for each of the given labels. Naming them spares the pass that would look for them."""
    return df.groupBy(*by).pivot(label, list(values)).agg(value)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "metric", "value")


def zero_filled(df: DataFrame, domain: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of the domain; values that are missing are 0."""
    return domain.join(df, list(key), "left").na.fill(0, list(values))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows...) that are in one frame and not in the other, as multisets."""
    only_a = a.exceptAll(b).withColumn("side", F.lit("a"))
    return only_a.unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def matrix(spark, dimensions: dict[str, Sequence]) -> DataFrame:
    """The combinations of a few small dimensions, built on the driver."""
    from itertools import product

    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds[type(v[0])]}" for n, v in dimensions.items())
    return spark.createDataFrame(list(product(*dimensions.values())), schema)


def tradeoff(predictive: DataFrame, resources: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictive and resource means side by side; keys include the classifier."""
    return predictive.join(resources, list(key))


def source_blocks(features: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """(name, n_blocks): of each set of features the number of source columns they come from."""
    f = F.col("__f")
    block = F.coalesce(*[F.when(f.startswith(p + "="), F.lit(p)) for p in prefixes], f)
    rows = features.select("name", F.explode(column).alias("__f"))
    return rows.groupBy("name").agg(F.countDistinct(block).alias("n_blocks"))
