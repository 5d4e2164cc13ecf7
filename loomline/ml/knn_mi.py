"""Mutual information of a continuous column and a class (Ross, 2014), on a bounded sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, NEIGHBOURS = 5_000, 3


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series from there on."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """In nats, at least 0. Classes with a single member are left out."""
    labels, count = np.unique(y, return_counts=True)
    keep = np.isin(y, labels[count > 1])
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    every = np.sort(x)
    terms = []
    for label in np.unique(y):
        own = np.sort(x[y == label])
        kk = min(k, len(own) - 1)
        d = np.full(len(own), np.inf)  # distance to the kk-th neighbour: among the kk windows around a value
        for a in range(kk + 1):
            lo, hi = np.arange(len(own)) - a, np.arange(len(own)) - a + kk
            ok = (lo >= 0) & (hi < len(own))
            d[ok] = np.minimum(d[ok], np.maximum(own[ok] - own[lo[ok]], own[hi[ok]] - own[ok]))
        radius = d * (1 - 1e-9)  # neighbours at the distance itself do not count
        m = np.searchsorted(every, own + radius, "right") - np.searchsorted(every, own - radius, "left")
        terms.append((len(own), digamma(np.array([kk]))[0], digamma(np.array([len(own)]))[0], digamma(np.maximum(m, 1)).sum()))
    n = sum(t[0] for t in terms)
    value = digamma(np.array([n]))[0] + sum(t[0] * (t[1] - t[2]) - t[3] for t in terms) / n
    return max(0.0, float(value))


def knn_mi(df: DataFrame, columns: Sequence[str], target: str, key: str, sample: int = SAMPLE, seed: int = 42) -> list[tuple[str, float]]:
    """(column, mi) from the ``sample`` rows that come first by a hash of the key."""
    rows = df.select(key, target, *[F.col(c).cast("double") for c in columns]).na.drop().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample).toPandas()
    y = rows[target].to_numpy()
    return [(c, mutual_information(rows[c].to_numpy(), y)) for c in columns]
