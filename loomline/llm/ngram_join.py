"""N-gram Jaccard self-join by MinHash banding.

Texts with the same words form one class, and classes, not copies, are compared. A class's
MinHash signature is cut into bands; classes that share a band's hash are candidates. A
bucket's smallest class is its leader, and the buckets of one leader are verified together:
near copies share most leaders, so a class's n-gram set travels to few places, once each. A
pair is counted with the smallest leader that both have in common, so exactly once. Large
groups are cut into blocks that are compared two at a time; a block pair is bounded in
classes and in n-grams, and gives counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, marked, materialize, one_space, text_batches, text_or_empty, tidy
from .graph import components
from .words import STEP, Words, mixed

N, THRESHOLD = 5, 0.8
#: Bands of ROWS hashes each. A pair at similarity s is found with probability
#: 1 - (1 - s**ROWS)**BANDS; see bands_for.
BANDS, ROWS = 20, 5
RECALL = 0.9995
#: Bounds of a block: classes and n-grams.
BLOCK_CLASSES, BLOCK_GRAMS = 1500, 1_000_000


def bands_for(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The least number of bands that finds pairs at the threshold with the given recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def class_key(text_col: str | Column) -> Column:
    """128 bits of the SHA-256 of the words joined by single spaces."""
    return F.unhex(F.substring(F.sha2(F.trim(one_space(text_col)), 256), 1, 32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram.

    Texts come as UTF-8.
    """

    def __init__(self, n: int = N):
        self.n, self.words = n, Words()
        self.power = np.array([pow(STEP, i + 1, 1 << 64) for i in range(n)], np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        return np.unique(self.of(self.words(text)[2]))

    def of(self, words: np.ndarray) -> np.ndarray:
        """The n-grams of hashed words in their order, repeats too."""
        n = min(self.n, len(words))
        x = np.zeros(len(words) - n + 1 if n else 0, np.uint64)
        for i in range(n):
            x += words[i : len(words) - n + 1 + i] * self.power[i]
        return mixed(x)


class Bander:
    """Hashes of the bands of a MinHash signature."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, grams: np.ndarray) -> list[int]:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 4096):
            low = np.minimum(low, (x[i : i + 4096, None] * self.a + self.b).min(axis=0))
        width = 4 * self.rows
        data = low.tobytes()
        return [
            xxhash.xxh3_64_intdigest(data[i * width : (i + 1) * width], seed=i) - (1 << 63) for i in range(self.bands)
        ]


    def many(self, sets: list[np.ndarray]) -> np.ndarray:
        """The bands of several sets of n-grams, none of them empty, shape (sets, bands)."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)))
        low = np.empty((self.bands * self.rows, len(sets)), np.uint32)
        y = np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(x, a, out=y)
            y += b
            np.minimum.reduceat(y, at, out=low[i])
        out = np.empty((self.bands, len(sets)), np.uint64)
        for i in range(self.bands):
            key = np.full(len(sets), i + 1, np.uint64)
            for row in low[i * self.rows : (i + 1) * self.rows]:
                key = mixed(key * np.uint64(STEP) + row)
            out[i] = key
        return out.T.view(np.int64)


def prefix(grams: np.ndarray, threshold: float) -> list[int]:
    """The least n-grams of a set, so many that sets at the threshold have one of these in common."""
    keep = len(grams) - math.ceil(threshold * len(grams) - 1e-9) + 1
    return (grams[:keep] ^ np.uint64(1 << 63)).view(np.int64).tolist()


def keys_of(grams: np.ndarray, band: Bander, prefix_upto: int, threshold: float) -> list[int]:
    """Of at most ``prefix_upto`` n-grams a prefix, of more the bands; larger sets that can link
    to such small ones have both."""
    found = prefix(grams, threshold) if 0 < len(grams) * threshold <= prefix_upto else []
    return found if len(grams) <= prefix_upto else found + band(grams)


def signatures(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, bands: int = BANDS, rows: int = ROWS,
    prefix_upto: int = 0, threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, node, grams, bands) of each row: its class, its number of n-grams, its bands.

    A text without words has no n-grams and no bands. Sets of at most ``prefix_upto`` n-grams
    have a prefix, which misses no pair, in place of bands; larger sets that can link to
    these have both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, band = Shingler(n), Bander(bands, rows)
        for batch in batches:
            sizes, out = [], []
            for text in batch.column(2):
                grams = shingle(text.as_py())
                sizes.append(len(grams))
                out.append(keys_of(grams, band, prefix_upto, threshold) if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["doc_id", "node", "grams", "bands"],
            )
        tidy()

    text_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), class_key(text_col).alias("node"), text_or_empty(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, node binary, grams long, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text, the last column, by its n-grams as bytes."""
    shingle = Shingler(N)
    for batch in batches:
        grams = [shingle(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(grams, pa.binary())], names=[*batch.schema.names[:-1], "set"]
        )
    tidy()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets with each other.

    N-grams that many sets have are multiplied as a dense matrix, the others are counted
    pair by pair.
    """
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")  # stable: the owners of an n-gram ascend
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    few = max(2, m // 10)
    dense = np.zeros((m, m), np.float32)
    many = np.flatnonzero(counts > few)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for k, j in enumerate(part):
            x[owner[starts[j] : starts[j] + counts[j]], k] = 1
        dense += x @ x.T
    upper = np.zeros(m * m, np.float32)
    waiting: list[np.ndarray] = []
    total = 0
    for c in np.unique(counts[(counts > 1) & (counts <= few)]).tolist():
        rows = owner[starts[counts == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                waiting.append(rows[:, i] * m + rows[:, j])
                total += len(rows)
                if total > 2_000_000:
                    upper += np.bincount(np.concatenate(waiting), minlength=m * m)
                    waiting, total = [], 0
    if waiting:
        upper += np.bincount(np.concatenate(waiting), minlength=m * m)
    upper = upper.reshape(m, m)
    out = dense + upper + upper.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(group: list[tuple], leader: bytes, across: bool, threshold: float) -> Iterator[tuple[bytes, int, bytes]]:
    """(node, links, root) of a block, or of two blocks against each other.

    A member of ``group`` is (node, block side, leaders, copies, set). Only pairs whose
    smallest common leader is this one count, and of two blocks only pairs across.
    """
    m = len(group)
    if m < 2:
        return
    sets = [g[4] for g in group]
    size = np.array([len(s) for s in sets], np.float32)
    common = intersections(sets)
    linked = common >= (threshold - 1e-9) * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if across:
        side = np.array([g[1] for g in group])
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return
    before = sorted({x for g in group for x in g[2] if x < leader})
    if before:
        at = {x: i for i, x in enumerate(before)}
        z = np.zeros((m, len(before)), np.float32)
        for i, g in enumerate(group):
            z[i, [at[x] for x in g[2] if x in at]] = 1
        linked &= (z @ z.T) == 0
    copies = np.array([g[3] for g in group], np.int64)
    links = linked.astype(np.float64) @ copies
    roots = _roots(linked)
    for i in np.flatnonzero(links):
        yield group[i][0], int(links[i]), group[roots[i]][0]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def flush() -> None:
            if key is not None:
                out.extend(_verified(group, key[0], key[1] != key[2], threshold))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            node, links, root = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())],
                names=["node", "links", "root"],
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for i, (leader, low, high, node, side, leaders, copies) in enumerate(zip(*columns, strict=True)):
                if (leader, low, high) != key:
                    flush()
                    key, group = (leader, low, high), []
                group.append((node, side, leaders, copies, np.frombuffer(batch.column(7)[i].as_buffer(), np.uint64)))
            if out:
                yield batch_of(out)
                out.clear()
        flush()
        if out:
            yield batch_of(out)
        tidy()

    return run


def near_classes(rows: DataFrame, source: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component, copies, links, class_id, keep_node) of each class that has more than
    one row or a link. links counts rows of other classes.

    ``rows`` is a written table as ``signatures`` gives it, ``source`` has the texts (doc_id,
    text) again, which are read only for rows that share a key with another class. A key's
    classes are counted by the key alone, so that the many keys of a single class cost a
    shuffle of longs and no more.
    """
    several = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "join-several")
    copied = marked(several, "node")
    merged = rows.filter(copied).groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max("grams").alias("grams"), F.first("bands").alias("bands")
    )
    merged = materialize(merged, "join-merged")
    single = rows.filter(~copied).select("node", F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("rep"), "grams", "bands")
    classes = single.unionByName(merged)
    banded = classes.select("node", "grams", F.explode("bands").alias("key"))
    twice = materialize(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "join-keys")
    shared = materialize(banded.filter(marked(twice, "key")), "join-shared")
    leaders = shared.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = materialize(leaders.select(F.col("key").alias("k"), "leader"), "join-leaders")
    members = materialize(shared.join(leaders, F.col("key") == F.col("k")).select("node", "grams", "leader").distinct(), "join-members")
    discard(twice, shared, leaders)
    groups = members.groupBy("leader").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    large = materialize(groups.filter("m > 1").select(F.col("leader").alias("l"), blocks.alias("blocks")), "join-groups")
    wanted = materialize(members.groupBy("node").agg(F.collect_set("leader").alias("leaders")), "join-wanted")  # at most one a key
    involved = classes.filter(marked(wanted, "node")).select(F.col("node").alias("node_"), "copies", "rep")
    involved = materialize(wanted.join(involved, F.col("node") == F.col("node_")).drop("node"), "join-involved")
    reps = involved.select(F.col("rep").alias("doc_id"))
    # the one-element explode keeps the planner from computing the key again for each use
    texts = (
        source.filter(marked(reps, "doc_id"))
        .withColumn("node", F.explode(F.array(class_key("text"))))
        .filter(marked(wanted, "node"))
        .join(involved, (F.col("node") == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        .select("node", "rep", "leaders", "copies", text_or_empty("text").cast("binary").alias("text"))
        .dropDuplicates(["node", "rep"])
        .drop("rep")
    )
    sets = texts.mapInArrow(_sets, "node binary, leaders array<binary>, copies long, set binary")
    placed = (
        sets.withColumn("leader", F.explode("leaders"))
        .join(large, F.col("leader") == F.col("l"))
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "leader", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
            "node", "side", "leaders", "copies", "set",
        )
    )
    found = (
        placed.repartition("leader", "low", "high")
        .sortWithinPartitions("leader", "low", "high")
        .mapInArrow(_verify(threshold), "node binary, links long, root binary")
    )
    found = materialize(found, "join-links")
    discard(members, large, wanted, involved)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = materialize(parts.join(links, "node"), "join-linked")
    nodes = (
        classes.filter((F.col("copies") > 1) | marked(linked, "node"))
        .select(F.col("node").alias("node_"), "copies", "rep")
        .join(linked, F.col("node_") == F.col("node"), "left")
        .filter("copies > 1 OR component IS NOT NULL")
        .select(F.col("node_").alias("node"), "copies", "rep", "links", F.coalesce("component", "node_").alias("component"))
    )
    nodes = materialize(nodes, "join-nodes")
    names = nodes.groupBy("component").agg(
        F.min(F.struct(F.col("rep").isNull().alias("z"), F.col("rep").alias("id"), F.col("node").alias("n"))).alias("first")
    )
    names = materialize(names.select(F.col("component").alias("c"), F.col("first.id").alias("class_id"), F.col("first.n").alias("keep_node")), "join-names")
    nodes_named = nodes.join(names, F.col("component") == F.col("c")).select(
        "node", "component", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id", "keep_node"
    )
    nodes_named = materialize(nodes_named, "join-result")
    discard(several, merged, found, linked, nodes, names)
    return nodes_named


def _signed(df: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The written signatures of ``df``, and the classes found among them."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(signatures(source, threshold=threshold), "join-signatures")
    return rows, near_classes(rows, source, threshold)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, n_grams.

    Words are what white space separates, case counts, and an n-gram is five of them; a text
    of fewer words is one n-gram. Rows link if the Jaccard similarity of their n-gram sets is
    ``threshold`` or more, and class_id is the smallest id of the rows that links connect.
    n_links counts the row's links: to rows with other words and to its n_copies - 1 copies.
    Null text is empty; texts without words are copies of each other and else have no links.
    Null ids come last, so class_id is null only where all ids of a class are. Repeated rows
    are copies. An empty table gives an empty table. Other columns are ignored.
    """
    rows, nodes = _signed(df, id_col, text_col, threshold)
    named = nodes.select(F.col("node").alias("node_"), "copies", "links", "class_id", "component")
    return rows.join(named, F.col("node") == F.col("node_"), "left").select(
        "doc_id",
        F.when(F.col("node_").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.col("grams").alias("n_grams"),
    )


def keep_first_of_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` without near duplicates, with all their columns.

    Of rows that links or copies connect, the one with the smallest id stays (null ids come
    last). Rows repeated with equal id and words count as one document and stay together.
    Rows without partners are not shuffled.
    """
    rows, nodes = _signed(df, id_col, text_col, threshold)
    near = nodes.select(F.col("node").alias("node_"), "class_id", "keep_node")
    stays = (F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = rows.filter(marked(nodes, "node")).join(near, F.col("node") == F.col("node_")).filter(~stays)
    gone = materialize(gone.select(F.col("doc_id").alias("id"), "node").distinct(), "join-gone")
    discard(rows, nodes)
    here = marked(gone, "id")
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    # only rows with an id of these are given the key of their words
    rest = packed.filter(here).withColumn("node", F.explode(F.array(class_key(F.col("row")[text_col]))))
    named = gone.select(F.col("id").alias("id_"), F.col("node").alias("node_"))
    rest = rest.join(named, F.col("id").eqNullSafe(F.col("id_")) & (F.col("node") == F.col("node_")), "left_anti")
    return packed.filter(~here).select("row.*").unionByName(rest.select("row.*"))
