"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks and racks in regions. A row descends from the root: at each level
every child draws ``ln(u) / weight`` with u hashed from the row's key and the child's
name, and the largest draw wins. Only a child whose weight grew can win rows it did not
have, so movement is confined to subtrees whose weights change; a shard that is added in a
region of its own takes rows only into itself. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash60, materialize, text_or_empty

SHARDS = 8
#: Parts of a shard within which rows are numbered: at least so many, and more where a part
#: would have more than PART_ROWS rows. The table of their counts has a row a part.
SLOT_PARTS, PART_ROWS = 256, 100_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(n: int, base: int = SHARDS) -> list[Shard]:
    """``base`` shards, two a rack and two racks a region; each further one in a region of its own."""
    first = [Shard(f"region{i // 4}", f"rack{i // 2}", i) for i in range(min(n, base))]
    return first + [Shard(f"region-{i}", f"rack-{i}", i) for i in range(base, n)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (hash60(key, F.lit(name)).cast("double") + F.lit(1.0)) / F.lit(float(1 << 60) + 1.0)
    return F.ln(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The result of the child with the largest draw; of equal draws the first child's."""
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in children]
    best = F.greatest(*draws)
    out = children[-1][2]
    for draw, (_, _, result) in list(zip(draws, children, strict=True))[-2::-1]:
        out = F.when(draw == best, result).otherwise(out)
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of ``key``. Names, not positions, feed the draws. Weights sum upwards."""
    if not any(s.weight > 0 for s in tree):
        raise ValueError("no shard has a positive weight")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    top = []
    for region, racks in regions.items():
        middle = []
        for rack, shards in racks.items():
            leaves = [(f"shard{s.shard}", s.weight, F.lit(s.shard)) for s in shards]
            if weight := sum(s.weight for s in shards if s.weight > 0):
                middle.append((rack, weight, _pick(key, leaves)))
        if middle:
            top.append((region, sum(w for _, w, _ in middle), _pick(key, middle)))
    return _pick(key, top)


def shard_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree: list[Shard] | None = None,
    grown: list[Shard] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: 1). The law is ``key``: the id and the
    tree decide; grown_shard is the shard under ``grown``, by default one more shard. slot
    numbers the rows of a shard from 0 without gaps: rows are counted in parts of a shard,
    numbered within, and moved up by the counts of the parts before. Null ids have one key
    in common; rows with equal ids share a shard and are ordered by their text's checksum
    and size. An empty table gives an empty table. Other columns are ignored.
    """
    tree = tree or layout(SHARDS)
    grown = grown or layout(SHARDS + 1)
    text = text_or_empty(text_col)
    key = F.col("doc_id")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        shard_of(key, tree).cast("int").alias("shard"),
        shard_of(key, grown).cast("int").alias("grown_shard"),
        (hash60(key, F.lit("part")) + F.col("text_crc32")).alias("__part"),
    )
    rows = materialize(rows, "shard-rows")
    parts = max(SLOT_PARTS, -(-rows.count() // (len(tree) * PART_ROWS)))
    rows = rows.withColumn("__part", F.pmod("__part", F.lit(parts)))
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    up = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("__shard"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("__i", F.row_number().over(inside) - 1)
        # one row for each part of each shard: a hundred thousandth of the rows, left to the planner
        .join(starts, (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__p")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("__start") + F.col("__i")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
