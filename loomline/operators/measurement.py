"""Measurement records: a value with metric, unit, provenance and phase, checked as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "metric string, value double, unit string, provenance string, phase string"
UNITS = {"wall_time": "s", "cpu_time": "s", "memory": "MiB", "energy": "J", "size": "B"}
PROVENANCES = ("measured", "derived", "estimated", "unavailable")
PHASES = ("training", "inference")


def valid(row: str = "") -> Column:
    """The metric has its unit, the provenance and phase are known, and a value is there unless it is unavailable."""
    c = lambda n: F.col(f"{row}.{n}" if row else n)
    unit = F.lit(False)
    for metric, u in UNITS.items():
        unit |= (c("metric") == metric) & (c("unit") == u)
    value = F.when(c("provenance") == "unavailable", c("value").isNull()).otherwise(c("value").isNotNull() & (c("value") >= 0) & ~F.isnan(c("value")))
    return F.coalesce(unit & c("provenance").isin(*PROVENANCES) & c("phase").isin(*PHASES) & value, F.lit(False))


def check(records: DataFrame) -> DataFrame:
    """(n, n_invalid) of a table of records."""
    return records.agg(F.count("*").alias("n"), F.count_if(~valid()).alias("n_invalid"))
