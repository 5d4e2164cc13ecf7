"""Feature selectors behind one interface: fitted on training rows, they project any rows.

Statistics come from Spark, a row a column; the choice among columns is made on the driver.
Selectors that share one pass over the rows get its sums as ``found``, in the order of the columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml.histograms import Moments
from . import filters, stats


@dataclass(frozen=True)
class Selection:
    """What a selector chose: ``columns`` are in the order of ``candidates``, ``scores`` by column."""

    selector: str
    candidates: tuple[str, ...]
    columns: tuple[str, ...]
    scores: dict[str, float | None]

    def transform(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """The keys and the chosen columns; columns that are unexpected or missing fail."""
        odd = [c for c in df.columns if c not in (*self.candidates, *keys)]
        gone = [c for c in (*keys, *self.candidates) if c not in df.columns]
        if odd or gone:
            raise ValueError(f"unexpected columns: {odd}, missing columns: {gone}")
        return df.select(*keys, *self.columns)


def _chosen(selector: str, candidates: Sequence[str], keep: Sequence[str], scores: dict) -> Selection:
    return Selection(selector, tuple(candidates), tuple(c for c in candidates if c in set(keep)), scores)


def _best(scores: dict[str, float | None], candidates: Sequence[str], k: int) -> list[str]:
    """The k largest scores, undefined ones last, ties by place."""
    if not 0 < k <= len(candidates):
        raise ValueError(f"cannot choose {k} of {len(candidates)} columns")
    order = sorted(range(len(candidates)), key=lambda i: (scores[candidates[i]] is None, -(scores[candidates[i]] or 0.0), i))
    return [candidates[i] for i in order[:k]]


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, variance) of the population, in one pass."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])))
    return long.groupBy("column_name").agg(F.var_pop("v").alias("variance"))


def by_variance(df: DataFrame, columns: Sequence[str], target: str | None = None, k: int | None = None, found: Moments | None = None) -> Selection:
    """All columns whose variance is not exactly 0."""
    if found is None:
        scores = {r["column_name"]: r["variance"] for r in variances(df, columns).collect()}  # a row a column
    else:
        scores = dict(zip(columns, map(float, found.variances()), strict=True))
    scores = {c: scores.get(c) for c in columns}
    return _chosen("variance", columns, [c for c in columns if scores[c]], scores)


def _absolute(found: Moments | None, columns: Sequence[str]) -> dict[tuple[str, str], float] | None:
    """The absolute correlation of each pair, 0 where it is undefined."""
    if found is None:
        return None
    r = found.correlations()
    return {(a, b): 0.0 if math.isnan(r[i, j]) else round(abs(float(r[i, j])), 12) for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j}


def by_redundancy(df: DataFrame, columns: Sequence[str], target: str | None = None, k: int | None = None, found: Moments | None = None) -> Selection:
    """The first k columns of the redundancy ranking."""
    ranked = filters.redundancy_ranking(df, columns, _absolute(found, columns))
    return _chosen("redundancy", columns, ranked[: k or len(ranked)], {c: float(i) for i, c in enumerate(ranked)})


def by_correlation(df: DataFrame, columns: Sequence[str], target: str | None = None, k: int | None = None, found: Moments | None = None) -> Selection:
    """The columns without a kept earlier one of |r| 0.95 or more."""
    kept, dropped = filters.correlation_filter(df, columns, r=_absolute(found, columns))
    return _chosen("correlation", columns, kept, {c: r for c, _, r in dropped} | {c: None for c in kept})


def by_anova(df: DataFrame, columns: Sequence[str], target: str, k: int, found: Moments | None = None) -> Selection:
    """The k columns with the largest F statistic."""
    if found is None:
        f = {r["column_name"]: r["f"] for r in stats.anova_f(df, columns, target, digits=12).collect()}
    else:
        f = {c: None if math.isnan(v) else round(float(v), 12) for c, v in zip(columns, found.f(), strict=True)}
    scores = {c: f.get(c) for c in columns}
    return _chosen("anova", columns, _best(scores, columns, k), scores)


def by_mutual_information(df: DataFrame, columns: Sequence[str], target: str, k: int) -> Selection:
    """The k columns of levels with the most information on the target."""
    found = {r["column_name"]: r["mi"] for r in stats.discrete_mutual_information(df, columns, target, digits=12).collect()}
    scores = {c: found.get(c) for c in columns}
    return _chosen("mutual_information", columns, _best(scores, columns, k), scores)


SELECTORS: dict[str, Callable[..., Selection]] = {
    "variance": by_variance, "correlation": by_correlation, "redundancy": by_redundancy, "anova": by_anova, "mutual_information": by_mutual_information,
}


def create(selector: str) -> Callable[..., Selection]:
    if selector not in SELECTORS:
        raise ValueError(f"no selector {selector}; known: {', '.join(SELECTORS)}")
    return SELECTORS[selector]


def ranked(selection: Selection, df: DataFrame) -> DataFrame:
    """(column_name, position) of the chosen columns by score, the largest first."""
    order = _best(selection.scores, [c for c in selection.candidates if c in selection.columns], len(selection.columns))
    return df.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "column_name string, position int")


def f_tail(f: float, between: int, within: int) -> float:
    """The chance of an F statistic of at least ``f``: the regularised incomplete beta function,
    by its continued fraction (Lentz)."""
    if f <= 0:
        return 1.0
    x = within / (within + between * f)
    a, b = within / 2, between / 2
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out
