"""Mixing sources to target weights by capped water-filling.

Every source wants its share of the mix, but none is taken more than ``max_epochs``
times. Shares above that are clamped and the excess goes to the others in proportion to
their weights until none is above. With sources ordered by the ratio of cap to weight,
the level at which that ends has a closed form, so one window over the table of sources
(one row a source) replaces the loop.

Documents are then taken whole as often as the source's target holds its size, and the
rest of the target is filled in an order given by a seeded hash. Running sums use two
levels (hash buckets, then rows of a bucket), and the buckets grow with the rows, so a
source with a third of all rows is spread over all of them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, hash60, materialize, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 7
#: Rows of a bucket if one source has them all, and the least number of buckets as a power of two.
BUCKET_ROWS, LEAST_BITS = 50_000, 10


def word_count(col: str | Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Give the sources, ordered by code point with null last, the weights in turn."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(table, (turn % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight).

    The targets add up to ``share`` of all sizes, or to all caps if these are less. A
    source of size 0 gets 0; an empty table stays empty. Weights must be positive.
    """
    w = Window.orderBy("__ratio", "__cap", F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        sources.withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("__ratio", F.col("__cap") / F.col("weight"))
        .withColumn("__total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.when(F.col("__left") < F.col("__ratio") * F.col("__w"), F.col("__left") / F.col("__w")))
        .withColumn("__level", F.max("__level").over(every))  # of the first source below its cap
        .withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap"))))
        .drop("__cap", "__ratio", "__total", "__left", "__w", "__level")
    )


def source_targets(sized: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of rows with source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    return water_fill(cycled_weights(totals), share, max_epochs)


def _ordered(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with __whole repetitions, __quota words beyond them and __before, the words of
    the rows of the source that come earlier in the seeded order."""
    bits = max(LEAST_BITS, (sized.count() // BUCKET_ROWS).bit_length())  # a written table
    rows = sized.withColumn("__h", hash60(F.lit(seed), F.col("doc_id"))).withColumn("__b", F.shiftright("__h", 60 - bits).cast("int"))
    per_bucket = rows.groupBy("source", "__b").agg(F.sum("size").alias("__s"))
    up = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("__start", F.coalesce(F.sum("__s").over(up), F.lit(0)))
    goal = targets.select(F.col("source").alias("__source"), "source_size", "target")
    starts = starts.join(goal, F.col("source").eqNullSafe(F.col("__source"))).select(
        F.col("source").alias("__source"), F.col("__b").alias("__bb"), "__start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "__b").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0)
    return (
        rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__bb")))
        .withColumn("__whole", whole.cast("long"))
        .withColumn("__quota", F.floor(F.col("target") + 0.5).cast("long") - F.col("__whole") * F.col("source_size"))
        .withColumn("__before", F.col("__start") + F.col("__in"))
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    size counts words; null text has none. taken is what the mix takes of the row, repeats
    counted: every row the whole repetitions of its source, and rows in the seeded order
    one more until the target is met, the last of them the part that is missing. So each
    source's taken words equal its target to the nearest word, and no row exceeds
    ``max_epochs`` times its size when that is whole. Null sources are a source of their
    own; rows with equal ids are told apart by size, and else are alike, so that it does
    not matter which comes first. An empty table gives an empty table. Other columns are
    ignored.
    """
    sized = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
        ),
        "mix-sizes",
    )
    rows = _ordered(sized, source_targets(sized, share, max_epochs), seed)
    extra = F.least(F.greatest(F.col("__quota") - F.col("__before"), F.lit(0)), F.col("size"))
    taken = F.col("__whole") * F.col("size") + extra
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all their columns.

    Documents stay whole: the row at the edge of a source's target is taken if that comes
    nearer to it. The decision of a row depends on its source and its seeded hash alone,
    so the texts are not shuffled; the table of sources has one row a source. Nulls as in
    ``mix``: a null source is a source, rows with a null or repeated id are taken together,
    and a text without words is taken as often as its source's order says. An empty table
    gives an empty table; columns of any name come through as they are.
    """
    sized = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
        ),
        "mix-sizes",
    )
    rows = _ordered(sized, source_targets(sized, share, max_epochs), seed)
    chosen = 2 * F.col("__before") + F.col("size") <= 2 * F.col("__quota")
    plan = materialize(
        rows.groupBy("source").agg(
            F.max("__whole").alias("__whole"), F.max(F.when(chosen & (F.col("__quota") > 0), F.col("__h"))).alias("__cut")
        ),
        "mix-plan",
    ).withColumnRenamed("source", "__source")
    times = F.coalesce("__whole", F.lit(0)) + F.when(F.col("__h") <= F.col("__cut"), 1).otherwise(0)
    packed = df.select(
        F.struct(*df.columns).alias("row"), F.col(source_col).cast("string").alias("__of"), hash60(F.lit(seed), F.col(id_col)).alias("__h")
    )
    return (
        packed.join(plan, F.col("__of").eqNullSafe(F.col("__source")), "left")
        .select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        .select("row.*")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, total - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS wrest
  FROM c WINDOW w AS (ORDER BY ratio, cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, max(CASE WHEN rest < ratio * wrest THEN rest / wrest END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM v
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.whole,
         floor(q.target + 0.5)::BIGINT - q.whole * q.source_size AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, source, size, source_size, target,
       (whole * size + least(greatest(quota - before, 0), size))::BIGINT AS taken
FROM r
"""
