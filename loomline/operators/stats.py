"""The statistics kernel: describe, paired comparison, correlation, ratios, selection filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import relative_loss, set_jaccard
from . import ranks

#: Fixed value: the 97.5 % quantile of Student's t with 4 degrees of freedom.
T_975_DF4 = 2.7764451051977987
PAIRS = 5


def cv_percent(mean: Column, sd: Column) -> Column:
    """100 sd / |mean|; for a mean of 0: 0 without spread, else infinite."""
    return F.when(F.abs(mean) < 1e-15, F.when(sd == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(100 * sd / F.abs(mean))


def group_describe(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """n, mean, sd (n - 1), min, median, max and variation of each group; null keys are a group."""
    v = F.col(value)
    mean, sd = F.avg(v), F.stddev_samp(v)
    rows = df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.round(mean, digits).alias("mean"),
        F.round(sd, digits).alias("sd"),
        F.round(F.min(v), digits).alias("min"),
        F.round(F.max(v), digits).alias("max"),
        F.round(cv_percent(mean, sd), digits).alias("cv_percent"),
    )
    return ranks.with_quantiles(rows, ranks.quantiles(df, value, [0.5], ["median"], by), by).withColumn("median", F.round("median", digits))


def two_level(df: DataFrame, by: Sequence[str], seed: str, value: str, digits: int = 4) -> DataFrame:
    """Means per seed, then their spread; and the variation within the most variable seed."""
    inner = df.groupBy(*by, seed).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    inner = inner.withColumn("cv", cv_percent(F.col("m"), F.col("s")))
    return inner.groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        F.round(F.avg("m"), digits).alias("mean_of_means"),
        F.round(cv_percent(F.avg("m"), F.stddev_samp("m")), digits).alias("between_cv"),
        F.round(F.avg("cv"), digits).alias("within_cv"),
        F.max_by(seed, "cv").cast("long").alias("most_variable_seed"),
    )


def paired(df: DataFrame, label: str, baseline: str, by: Sequence[str], seed: str, value: str) -> DataFrame:
    """(by, label, seed, value, base, difference): each candidate beside the baseline of its seed."""
    base = df.filter(F.col(label) == baseline).select(*by, seed, F.col(value).alias("base"))
    others = df.filter(F.col(label) != baseline)
    return others.join(base, [*by, seed]).withColumn("difference", F.col(value) - F.col("base"))


def paired_interval(pairs: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean difference with its 95 % interval; the interval is null unless there are five pairs.

    direction tells the sign that all pairs share, or mixed; effect what the interval's
    sign says.
    """
    d = F.col("difference")
    half = F.when(F.count(d) == PAIRS, T_975_DF4 * F.stddev_samp(d) / F.sqrt(F.lit(float(PAIRS))))
    low, high = F.avg(d) - half, F.avg(d) + half
    return pairs.groupBy(*by).agg(
        F.count(d).alias("n_pairs"),
        F.round(F.avg(d), digits).alias("mean_difference"),
        F.round(F.stddev_samp(d), digits).alias("sd_difference"),
        F.round(low, digits).alias("ci_low"),
        F.round(high, digits).alias("ci_high"),
        F.when(low > 0, "increase").when(high < 0, "reduction").otherwise("uncertain").alias("effect"),
        F.when(F.bool_and(d < 0), "all_below").when(F.bool_and(d > 0), "all_above").otherwise("mixed").alias("direction"),
        F.count_if(d < 0).alias("n_below"),
        F.count_if(d == 0).alias("n_equal"),
        F.count_if(d > 0).alias("n_above"),
        F.round(F.percentile(d, F.lit(0.5)), digits).alias("median_difference"),
    )


def preservation(candidates: DataFrame, base: DataFrame, key: Sequence[str], margins: dict[str, float], slack: float = 1e-12) -> DataFrame:
    """Relative losses of each metric against the baseline and whether all stay within their margins."""
    rows = candidates.join(base.select(*key, *[F.col(m).alias(f"base_{m}") for m in margins]), list(key))
    losses = {f"loss_{m}": relative_loss(F.col(f"base_{m}"), F.col(m)) for m in margins}
    rows = rows.withColumns(losses)
    ok = F.lit(True)
    for m, margin in margins.items():
        ok &= F.col(f"loss_{m}") <= margin + slack
    return rows.withColumn("preserved", ok)


def pooled_rate(df: DataFrame, by: Sequence[str], num: str, den: str, digits: int = 6) -> DataFrame:
    """Sum over sum; null where the denominators add up to 0."""
    return df.groupBy(*by).agg(
        F.sum(num).alias("numerator"), F.sum(den).alias("denominator"),
        F.round(F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")), digits).alias("rate"),
    )


def normalized_ratios(df: DataFrame, key: Sequence[str], label: str, baseline: str, value: str, digits: int = 6) -> DataFrame:
    """Each label's value over the baseline's in the same cell; cells whose baseline is not positive are left out."""
    base = df.filter((F.col(label) == baseline) & (F.col(value) > 0)).select(*key, F.col(value).alias("base"))
    return df.filter(F.col(label) != baseline).join(base, list(key)).select(*key, label, F.round(F.col(value) / F.col("base"), digits).alias("ratio"))


def break_even(overhead: Column, saving: Column) -> Column:
    """Repetitions after which a saving has paid an overhead; null where nothing is saved."""
    return F.when(saving > 0, F.ceil(overhead / saving))


def reduction_percent(base: Column, value: Column) -> Column:
    return F.try_divide(100.0 * (base - value), base)


#: From more columns than these on, correlations come from products of Arrow batches.
WIDE = 12


def _wide_pearson(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """As :func:`pearson_matrix`: a task gives sums for each pair of columns, of values less the column's mean."""
    names, p = list(columns), len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    span = rows.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()  # one row
    shift = np.array([span[f"m{i}"] or 0.0 for i in range(p)])
    flat = [i for i in range(p) if span[f"lo{i}"] == span[f"hi{i}"]]
    above = np.triu_indices(p, 1)
    sums = ("n", "x", "y", "xx", "yy", "xy")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), p, p))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - shift
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (above[0].astype(np.int32), above[1].astype(np.int32), *(t[above] for t in total))], names=["i", "j", *sums])

    per = rows.mapInArrow(add, "i int, j int, " + ", ".join(f"{c} double" for c in sums)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    vx, vy = mean("xx") - mean("x") * mean("x"), mean("yy") - mean("y") * mean("y")
    usable = (vx > 0) & (vy > 0) & ~F.col("i").isin(flat) & ~F.col("j").isin(flat)
    r = F.when(usable, (mean("xy") - mean("x") * mean("y")) / F.sqrt(vx) / F.sqrt(vy))
    name = F.array(*[F.lit(c) for c in names])
    return per.select(F.element_at(name, F.col("i") + 1).alias("a"), F.element_at(name, F.col("j") + 1).alias("b"), F.round(r, digits).alias("r"))


def pearson_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """(a, b, r) of each pair of columns, from sums of complete pairs in one pass; null for a constant.

    An aggregate for each pair is fast for few columns; plans of thousands do not end, so that
    wide frames are multiplied as matrices.
    """
    if len(columns) > WIDE:
        return _wide_pearson(df, columns, digits)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        flat = (F.coalesce(F.var_pop(x), F.lit(0.0)) <= 0) | (F.coalesce(F.var_pop(y), F.lit(0.0)) <= 0)
        aggs.append(F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"v{i}"))
    row = df.agg(*aggs)
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"v{i}"), digits).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*items)))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``: the mean position of equal values, from counts of distinct values."""
    found = ranks.counted(df, value, by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    return df.join(found.select(*by, value, "rank"), [*by, value])


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson's correlation of average ranks in each group."""
    x = average_rank(df, a, by).withColumnRenamed("rank", "__ra")
    y = average_rank(x, b, by).withColumnRenamed("rank", "__rb")
    return y.groupBy(*by).agg(F.round(F.corr("__ra", "__rb"), digits).alias("spearman"))


def kendall_tau_b(df: DataFrame, item: str, a: str, b: str, digits: int = 6) -> DataFrame:
    """Tau-b of two scores over a small set of items (features, configurations): one row.

    Each item gets the counts of the items after it; the set is gathered in one array,
    which is meant for hundreds of items, not for rows of data.
    """
    rows = df.select(item, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    every = rows.agg(F.array_sort(F.collect_list(F.struct(item, "x", "y"))).alias("all"))
    pair = rows.join(F.broadcast(every)).select(
        F.aggregate(
            F.filter("all", lambda o: o[item] > F.col(item)),
            F.struct(*[F.lit(0).cast("long").alias(n) for n in ("s", "tx", "ty", "n")]),
            lambda acc, o: F.struct(
                (acc.s + (F.signum(o.x - F.col("x")) * F.signum(o.y - F.col("y"))).cast("long")).alias("s"),
                (acc.tx + (o.x != F.col("x")).cast("long")).alias("tx"),
                (acc.ty + (o.y != F.col("y")).cast("long")).alias("ty"),
                (acc.n + 1).alias("n"),
            ),
        ).alias("c")
    )
    row = pair.agg(F.sum("c.s").alias("s"), F.sum("c.tx").alias("tx"), F.sum("c.ty").alias("ty"), F.sum("c.n").alias("n_pairs"))
    return row.select("n_pairs", F.round(F.try_divide(F.col("s").cast("double"), F.sqrt(F.col("tx") * F.col("ty").cast("double"))), digits).alias("tau_b"))


def anova_f(df: DataFrame, columns: Sequence[str], target: str, digits: int = 4) -> DataFrame:
    """(column_name, f): the F statistic of each column between the target's classes; null if undefined."""
    long = df.select(target, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))).filter("v IS NOT NULL")
    per = long.groupBy("column_name", target).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    means = Window.partitionBy("column_name")
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(means) / F.sum("n").over(means))
    row = per.groupBy("column_name").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("s")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"),
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return row.select("column_name", F.round(F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), f), digits).alias("f"))


def discrete_mutual_information(df: DataFrame, columns: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """(column_name, mi) in nats, from counts; a null level is a level."""
    long = df.select(F.col(target).cast("string").alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("x")) for c in columns])))
    n = long.groupBy("column_name", "x", "y").agg(F.count("*").alias("n"))
    px, py, all_ = (Window.partitionBy("column_name", *k) for k in (["x"], ["y"], []))
    rows = n.select("column_name", "n", F.sum("n").over(px).alias("nx"), F.sum("n").over(py).alias("ny"), F.sum("n").over(all_).alias("t"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    return rows.groupBy("column_name").agg(F.round(F.greatest(F.sum(term), F.lit(0.0)), digits).alias("mi"))


def rank_scores(scores: DataFrame, score: str, name: str = "column_name") -> DataFrame:
    """Add ``position``: larger scores first, undefined ones last, ties by name."""
    return scores.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), name)))


def pairwise_jaccard(sets: DataFrame, key: str, items: str, digits: int = 6) -> DataFrame:
    """(a, b, jaccard) of each pair of a small number of sets, by an inequality join on their names."""
    a = sets.select(F.col(key).alias("a"), F.col(items).alias("x"))
    b = sets.select(F.col(key).alias("b"), F.col(items).alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(set_jaccard("x", "y"), digits).alias("jaccard"))


def overlap_blocks(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(a, b, both, only_a, only_b): the shared and the own items of each pair of sets, sorted and joined."""
    a = sets.select(F.col(key).alias("a"), F.col(items).alias("x"))
    b = sets.select(F.col(key).alias("b"), F.col(items).alias("y"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return a.join(b, F.col("a") < F.col("b")).select(
        "a", "b", text(F.array_intersect("x", "y")).alias("both"), text(F.array_except("x", "y")).alias("only_a"), text(F.array_except("y", "x")).alias("only_b")
    )


def item_frequency(sets: DataFrame, items: str, least: int = 1) -> DataFrame:
    """(item, n): how many sets hold each item, from ``least`` on."""
    return sets.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def contamination_sensitivity(scores: DataFrame, shares: Sequence[float], by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(by, contamination, threshold, n_flagged, percent): what each assumed share of anomalies flags.

    Thresholds are quantiles of all scores, which come as one row.
    """
    cut = ranks.quantiles(scores, score, [1 - s for s in shares], [f"t{i}" for i in range(len(shares))])
    table = cut.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("contamination"), F.col(f"t{i}").alias("threshold")) for i, s in enumerate(shares)])))
    rows = scores.join(F.broadcast(table))
    hit = F.col(score) > F.col("threshold")
    return rows.groupBy(*by, "contamination").agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.count_if(hit).alias("n_flagged"), F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("percent")
    )


def timing_quality(df: DataFrame, by: Sequence[str], order: str, time: str, limit_s: float) -> DataFrame:
    """Gaps between observations in order: the longest, the mean, and how many exceed a limit."""
    w = Window.partitionBy(*by).orderBy(order)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    rows = df.select(*by, (gap / 1e6).alias("gap"))
    return rows.groupBy(*by).agg(
        F.round(F.max("gap"), 3).alias("longest"), F.round(F.avg("gap"), 3).alias("mean"), F.count_if(F.col("gap") > limit_s).alias("n_over")
    )


def latency_and_throughput(wall_s: Column, operations: Column, records: Column) -> dict[str, Column]:
    return {
        "s_per_operation": F.try_divide(wall_s, operations), "s_per_record": F.try_divide(wall_s, records), "records_per_s": F.try_divide(records, wall_s),
    }


def energy_estimate_j(seconds: Column, cpu_w: float = 65.0, ram_w: float = 3.0) -> Column:
    """An estimate from rated power, not a measurement."""
    return seconds * (cpu_w + ram_w)


def counter_delta(df: DataFrame, by: Sequence[str], order: str, counter: str, maximum: float) -> DataFrame:
    """Add ``delta`` of a counter that starts over after ``maximum``; null for the first reading."""
    before = F.lag(counter).over(Window.partitionBy(*by).orderBy(order))
    now = F.col(counter)
    return df.withColumn("delta", F.when(now < before, F.lit(maximum) - before + now).otherwise(now - before))


def running_best(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Add ``best`` so far and whether the step improved it."""
    w = Window.partitionBy(*by).orderBy(step)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best", F.max(value).over(upto)).withColumn("improved", F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True)))
