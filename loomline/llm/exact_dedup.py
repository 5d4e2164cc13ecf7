"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by the hash of a prefix, and only rows of groups that
still have two members get a hash of their full content. Which rows these are is told by
bitmaps that grow with the groups up to a bound, so no row is shuffled to find out. Group tables hold one row a
group and are built by aggregates that combine before the shuffle, so a group with a
third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, marked, materialize, one_space

PREFIX_CHARS = 256


def _signed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with __norm, __len and __prefix. The one-element explode keeps the planner from
    computing the normalised text again for each use."""
    return (
        df.withColumn("__once", F.array(one_space(text_col)))
        .withColumn("__norm", F.explode("__once"))
        .drop("__once")
        .withColumn("__len", F.length("__norm"))
        .withColumn("__prefix", F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)))
    )


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column]:
    """The groups of at least two equal texts, and the test for rows that may be in one.

    Returns ``(groups, survives)``. ``groups`` has __sha, keep_id (the smallest id, null
    ids last), group_size and __at_min (rows that carry keep_id). ``survives`` is a
    condition on __len and __prefix.
    """
    thin = materialize(_signed(df, text_col).select("__len", "__prefix"), "dedup-thin")
    by_length = thin.groupBy("__len").agg(F.count("*").alias("__n")).filter("__n > 1")
    long_enough = marked(materialize(by_length.select("__len"), "dedup-lengths"), "__len")
    by_prefix = thin.filter(long_enough).groupBy("__len", "__prefix").agg(F.count("*").alias("__n")).filter("__n > 1")
    survives = marked(materialize(by_prefix.select("__len", "__prefix"), "dedup-prefixes"), "__len", "__prefix")
    hashed = (
        _signed(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
        .filter(survives)
        .select("__id", F.sha2("__norm", 256).alias("__sha"))
    )
    groups = (
        hashed.groupBy("__sha", "__id")
        .agg(F.count("*").alias("__n"))
        .groupBy("__sha")
        .agg(
            F.min(F.struct(F.col("__id").isNull().alias("z"), F.col("__id").alias("id"), F.col("__n").alias("n"))).alias("m"),
            F.sum("__n").alias("group_size"),
        )
        .filter("group_size > 1")
        .select("__sha", F.col("m.id").alias("keep_id"), "group_size", F.col("m.n").alias("__at_min"))
    )
    groups = materialize(groups, "dedup-groups")
    discard(thin)
    return groups, survives


def _one_of_ties(rows: DataFrame) -> DataFrame:
    """Set __kept for one row only where several rows of a group carry its smallest id."""
    tied = F.col("__kept") & (F.col("__at_min") > 1)
    plain = rows.filter(~tied)
    same = ["__sha", "__id"]
    # first within each part, then among the parts' firsts: no task gets all rows of an id
    first = (
        rows.filter(tied)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__r", F.row_number().over(Window.partitionBy(*same, "__part").orderBy(F.lit(1))))
    )
    lead = first.filter("__r = 1").withColumn(
        "__kept", F.row_number().over(Window.partitionBy(*same).orderBy("__part")) == 1
    )
    rest = first.filter("__r > 1").withColumn("__kept", F.lit(False))
    return plain.unionByName(lead.select(plain.columns)).unionByName(rest.select(plain.columns))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null
    counts as empty. The row with the smallest id stays; null ids come last; of repeated
    rows with that id one stays. text_sha256 is null for rows whose content was not read
    in full, unless ``digest_all`` asks for the digests of all rows. An empty table gives
    an empty table. Other columns of ``df`` are ignored, whatever their names.
    """
    df = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    groups, survives = duplicate_groups(df, "__id", "__text")
    sha = F.sha2("__norm", 256)
    rows = _signed(df, "__text").select(
        "__id", (sha if digest_all else F.when(survives, sha)).alias("__sha"), F.xxhash64("__len", "__prefix", "__id").alias("__h")
    )
    # rows without a digest get keys of their own: nulls would all meet in one task
    rows = rows.withColumn("__key", F.coalesce("__sha", F.concat(F.lit("-"), F.col("__h"))))
    out = rows.join(groups.withColumnRenamed("__sha", "__key"), "__key", "left").select(
        "__id",
        "__sha",
        F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("__kept"),
        F.coalesce("__at_min", F.lit(1)).alias("__at_min"),
    )
    if not groups.filter("__at_min > 1").isEmpty():
        out = _one_of_ties(materialize(out, "dedup-ties"))
    return out.select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size", F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Only rows that may have a copy pass through a shuffle. Ties and nulls as in
    :func:`exact_dedup`; columns of any name come through as they are.
    """
    packed = df.select(F.struct(*df.columns).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    groups, survives = duplicate_groups(packed, "__id", "__text")
    signed = _signed(packed, "__text")
    alone = signed.filter(~survives).select("__row")
    rows = signed.filter(survives).select("__row", "__id", F.sha2("__norm", 256).alias("__sha"))
    renamed = groups.select(F.col("__sha").alias("__key"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"), "__at_min")
    kept = (
        rows.join(renamed, F.col("__sha") == F.col("__key"), "left")
        .withColumn("__kept", F.col("__size").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
        .withColumn("__at_min", F.coalesce("__at_min", F.lit(1)))
        .filter("__kept")
    )
    if not groups.filter("__at_min > 1").isEmpty():
        kept = _one_of_ties(materialize(kept, "dedup-ties")).filter("__kept")
    return alone.unionByName(kept.select("__row")).select("__row.*")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h
"""
