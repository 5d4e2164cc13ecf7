"""Reports: flat facts, audits, gaps, paired summaries, accounting, publication tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality

#: Columns that trace a processed row back to its order line.
METADATA = ("item_id", "order_id", "line_number", "customer_id", "product_id", "order_ts", "ship_ts", "market", "segment")


def metadata(df: DataFrame, columns: Sequence[str] = METADATA) -> DataFrame:
    """The columns that trace a row, in their order; a missing one fails."""
    return quality.require_columns(df, columns).select(*columns)


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two frames' columns side by side, rows matched by a key that must be unique and the same in both."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n), *[F.first(c).alias(c) for c in df.columns if c != key]) for df, n in ((left, "__a"), (right, "__b")))
    both = a.join(b, key, "full_outer")
    one = F.coalesce(F.col("__a") == 1, F.lit(False)) & F.coalesce(F.col("__b") == 1, F.lit(False))
    check = F.when(one, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single partner for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return both.filter(check).drop("__a", "__b")


def flat(df: DataFrame) -> DataFrame:
    """Nested structs as columns named by their paths, joined by underscores; arrays and maps stay."""

    def walk(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in at)).alias("_".join(at)))
        return out

    return df.select(*walk(df.schema, ()))


def by_rank(df: DataFrame, column: str, order: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows in the given order of a column's values; others last, by value."""
    place = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return df.orderBy(place, column, *then)


def full_audit(df: DataFrame, name: str) -> DataFrame:
    """(source, section, item, value): rows, repeated rows, nulls, distinct values, roles and leakage candidates of a table."""
    spark = df.sparkSession
    rows = quality.duplicate_rows(df).select(
        F.inline(F.array(*[F.struct(F.lit("rows").alias("section"), F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in ("n_rows", "n_distinct", "n_duplicate")]))
    )
    profile = quality.null_profile(df).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("section"), F.col("column_name").alias("item"), F.col(c).cast("string").alias("value")) for c in ("n_null", "n_distinct")]))
    )
    roles = spark.createDataFrame([("role", c, r) for c, r in quality.column_roles(df)], "section string, item string, value string")
    leaks = quality.leakage_candidates(df).select(F.lit("leakage").alias("section"), F.col("column_name").alias("item"), F.col("reason").alias("value"))
    out = rows.unionByName(profile).unionByName(roles).unionByName(leaks)
    return out.select(F.lit(name).alias("source"), "section", "item", "value")


def generalisation_gap(df: DataFrame, by: Sequence[str], split: str, value: str, digits: int = 6) -> DataFrame:
    """(by, validation, test, gap): means of both splits, and how much larger the test's is."""
    mean = lambda s: F.avg(F.when(F.col(split) == s, F.col(value)))
    return df.groupBy(*by).agg(
        F.round(mean("validation"), digits).alias("validation"), F.round(mean("test"), digits).alias("test"), F.round(mean("test") - mean("validation"), digits).alias("gap")
    )


def paired_signs(pairs: DataFrame, by: Sequence[str], difference: str = "difference", digits: int = 6) -> DataFrame:
    """Signs and spread of paired differences; ``safeguard`` is REVIEW if any is negative, else PASS."""
    d = F.col(difference)
    return pairs.groupBy(*by).agg(
        F.count(d).alias("n"), F.round(F.avg(d), digits).alias("mean"), F.round(F.median(d), digits).alias("median"), F.round(F.min(d), digits).alias("min"),
        F.round(F.max(d), digits).alias("max"), F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"), F.count_if(d > 0).alias("positive"),
        F.when(F.count_if(d < 0) > 0, F.lit("REVIEW")).otherwise("PASS").alias("safeguard"),
    )


def search_accounting(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of requests, evaluations, cache hits and seconds; ``consistent`` if requests are evaluations plus hits in every run."""
    ok = F.col("requests") == F.col("evaluated") + F.col("hits")
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("requests", "evaluated", "hits")], F.round(F.sum("seconds"), 6).alias("seconds"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("consistent"),
    )


def publication_table(facts: DataFrame, by: Sequence[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """(by, n, and of each metric the text of mean and sample deviation): as tables print them."""
    text = lambda c: F.concat(
        F.format_string(f"%.{digits}f", F.avg(c)), F.lit(" ± "), F.format_string(f"%.{digits}f", F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    )
    return facts.groupBy(*by).agg(F.count("*").alias("n"), *[text(c).alias(c) for c in metrics])


def record_coverage(chains: DataFrame, records: DataFrame, key: str = "order_id") -> DataFrame:
    """(n_chains, n_records, n_without_record, n_without_chain, n_mismatched): whether each chain's
    reference and each risk record are of one another. Digests are compared where both are."""
    a = chains.select(key, F.element_at("chain", -1).ai_risk_reference.record_digest.alias("__in_chain"), F.lit(1).alias("__a"))
    b = records.select(key, F.col("record_digest").alias("__in_record"), F.lit(1).alias("__b"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count("__a").alias("n_chains"), F.count("__b").alias("n_records"), F.count_if(F.col("__b").isNull()).alias("n_without_record"),
        F.count_if(F.col("__a").isNull()).alias("n_without_chain"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__in_chain").eqNullSafe(F.col("__in_record"))).alias("n_mismatched"),
    )


def visible_only(truth: DataFrame, predictions: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """(is_attack, flag) of the rows to judge: attacked rows whose inputs did not change are left out."""
    rows = truth.select(key, "is_attack").join(predictions.select(key, "flag"), key).join(visible.select(key, "visible"), key, "left")
    return rows.filter((F.col("is_attack") == 0) | F.coalesce("visible", F.lit(False))).select("is_attack", "flag")


def label_situation(security_labels: bool, targets: dict[str, bool], column: str | None) -> dict[str, object]:
    """Which judgement the labels allow: A with labels of attacks, C with an operational outcome
    only, B with neither. Only A allows supervised metrics."""
    present = bool(targets) and all(targets.values())
    case = "A" if security_labels and present else "C" if present and column else "B"
    return {"case": case, "target": None if case == "B" else column, "supervised_metrics_allowed": case == "A"}
