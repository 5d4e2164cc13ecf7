"""Feature filters: statistics come from Spark, greedy choices over a few dozen columns from the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .stats import pearson_matrix


def _matrix(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    out = {}
    for r in pearson_matrix(df, columns, digits=12).collect():  # a row a pair of columns
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = abs(r["r"]) if r["r"] is not None else 0.0
    return out


def correlation_filter(
    df: DataFrame, columns: Sequence[str], limit: float = 0.95, r: dict[tuple[str, str], float] | None = None
) -> tuple[list[str], list[tuple[str, str, float]]]:
    """(kept, dropped): a column goes if its |r| with a kept earlier one reaches the limit.

    dropped names the kept column with the largest |r|, of equal ones the earliest.
    ``r`` gives the absolute correlations if they are known.
    """
    r = _matrix(df, columns) if r is None else r
    kept: list[str] = []
    dropped = []
    for c in columns:
        over = [(-r[c, k], i, k) for i, k in enumerate(kept) if r[c, k] >= limit]
        if over:
            dropped.append((c, min(over)[2], -min(over)[0]))
        else:
            kept.append(c)
    return kept, dropped


def redundancy_ranking(df: DataFrame, columns: Sequence[str], r: dict[tuple[str, str], float] | None = None) -> list[str]:
    """Columns by least |r| to those ranked before, then least mean |r|, then position."""
    r = _matrix(df, columns) if r is None else r
    mean = {c: sum(r[c, k] for k in columns if k != c) / max(1, len(columns) - 1) for c in columns}
    ranked: list[str] = []
    while len(ranked) < len(columns):
        rest = [c for c in columns if c not in ranked]
        ranked.append(min(rest, key=lambda c: (max((r[c, k] for k in ranked), default=0.0), mean[c], columns.index(c))))
    return ranked


def nested_subsets(ranked: Sequence[str], shares: Sequence[float] = (1.0, 0.75, 0.5, 0.25)) -> dict[float, list[str]]:
    return {s: list(ranked[: max(1, round(len(ranked) * s))]) for s in shares}
