"""Substring deduplication: paragraphs and passages that repeat within and across documents.

Texts are cut at line feeds. Paragraphs of enough words get MinHash bands tuned for high
recall, paragraphs that collide are joined, their exact Jaccard similarity on five-word
n-grams is verified, and components of links decide what is removed: of each component the
first paragraph stays. The work on keys, blocks and components is that of ``ngram_join``,
with paragraphs in place of documents.

Passages are runs of words wherever lines end. Of each text's windows of ``ANCHOR`` words a
share is chosen by content (winnowing: the least hash of so many neighbours), such that
equal passages of ``PASSAGE`` words have a chosen one in common. Chosen windows that repeat
are joined to the first text that has them, or to their last place before in their own text,
windows that follow each other in both places make a run, and a run is extended word by word
at both ends as far as both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngram_join
from ._common import discard, marked, materialize, text_batches, text_or_empty, tidy
from .words import Rolling, Words, code_points

#: Words that a paragraph must have to be compared.
MIN_WORDS = 50
#: Hashes of a band; the number of bands follows from the recall that ``ngram_join`` asks for.
BAND_ROWS = 4
#: Words of the least passage that is surely found, and of the windows that are chosen to
#: find it, which are also the least that is reported.
PASSAGE, ANCHOR = 50, 25
#: Sets of so many n-grams or fewer, as of paragraphs up to 100 words, are found by prefix
#: where shorter paragraphs are asked for.
PREFIX_UPTO = 96
#: Chosen windows, and n-grams of paragraphs, that are held at a time.
_HELD, _GRAMS = 2_000_000, 30_000


def _batches(rows: Iterator[tuple], schema: pa.Schema, held: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``held``."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        if len(out) >= held:
            yield batch()
            out = []
    yield batch()


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = ngram_join.THRESHOLD) -> DataFrame:
    """(doc_id, para, start, end, node, grams, bands) of each line of at least ``min_words`` words.

    para counts all lines of the text from 0; start and end are code points, the end
    exclusive. node is the class of lines with the same words, grams the most n-grams
    they can have, bands the keys by which near copies meet. Null text has no paragraphs.
    """
    upto = PREFIX_UPTO if min_words < MIN_WORDS else 0
    bands = ngram_join.bands_for(BAND_ROWS, threshold)
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "para", "start", "end")] + [("node", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def lines(text: bytes, words: Words) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
        """Place, code points, words and their hashes of each line that is long enough."""
        starts, _, hashes = words(text)
        if len(starts) < min_words:
            return
        breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        begin, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(text)]))
        first = np.append(np.searchsorted(starts, begin), len(starts))
        points = code_points(text)
        for i in np.flatnonzero(np.diff(first) >= min_words).tolist():
            a, b = int(begin[i]), int(end[i])
            place = (a, b) if points is None else (int(points[a]), int(points[b]))
            yield i, *place, b" ".join(text[a:b].split()), hashes[first[i] : first[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, band = ngram_join.Shingler(), ngram_join.Bander(bands, BAND_ROWS)
        rows: list[tuple] = []
        sets: list[np.ndarray] = []

        def part() -> pa.RecordBatch:
            if upto:
                keys = [ngram_join.keys_of(g, band, upto, threshold) for g in sets]
            else:
                keys = band.many(sets).tolist() if sets else []
            columns = [*(zip(*rows, strict=True) if rows else [[]] * 5), [len(g) for g in sets], keys]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for para, a, b, line, hashes in lines(text.as_py(), shingle.words):
                    rows.append((doc_id, para, a, b, hashlib.sha256(line).digest()[:16]))
                    sets.append(np.unique(shingle.of(hashes)) if upto else shingle.of(hashes))
                    held += len(sets[-1])
                    if held > _GRAMS:
                        yield part()
                        rows, sets, held = [], [], 0
        yield part()
        tidy()

    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, para long, start long, end long, node binary, grams long, bands array<long>")


def repeated_paragraphs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = ngram_join.THRESHOLD
) -> DataFrame:
    """One row for each paragraph that has a near copy, in its own text or another.

    Returns doc_id, para, start, end, class_id, class_para, n_in_class, removed. Paragraphs
    whose five-word n-grams have a Jaccard similarity of ``threshold`` or more are linked,
    and links make classes; class_id and class_para name the class's first paragraph, by id
    (null ids last) and then place, which is the one that is not removed. Rows of ``df``
    that repeat with their id count as one document. An empty table gives an empty table.
    Other columns are ignored.
    """
    rows = materialize(paragraphs(df, id_col, text_col, min_words, threshold), "paragraphs")
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.split(text_or_empty(text_col), "\n", -1)).alias("text"))
    nodes = ngram_join.near_classes(rows.select("doc_id", "node", "grams", "bands"), source.filter(F.length("text") >= 2 * min_words - 1), threshold)
    placed = rows.filter(marked(nodes, "node")).select("doc_id", "para", "start", "end", "node")
    placed = placed.join(nodes.select(F.col("node").alias("node_"), "component"), F.col("node") == F.col("node_"))
    placed = materialize(placed.drop("node_", "node"), "paragraph-classes")
    first = placed.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("para").alias("p"))).alias("first"),
        F.count("*").alias("n_in_class"),
    )
    first = first.select(F.col("component").alias("c"), F.col("first.id").alias("class_id"), F.col("first.p").alias("class_para"), "n_in_class")
    first = materialize(first, "paragraph-firsts")
    discard(rows, nodes)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("para") == F.col("class_para"))
    return placed.join(first, F.col("component") == F.col("c")).select(
        "doc_id", "para", "start", "end", "class_id", "class_para", "n_in_class", (~stays).alias("removed")
    )


def windows(hashes: np.ndarray, length: int, rolling: Rolling) -> np.ndarray:
    """Hashes of all windows of ``length`` hashed words."""
    starts = np.arange(len(hashes) - length + 1)
    return rolling(hashes, starts, starts + length)


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The least or largest of each ``n`` neighbours, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def chosen(hashes: np.ndarray, near: int) -> np.ndarray:
    """The places whose hash is the least of some ``near`` neighbours."""
    least = _sliding(hashes, near, np.minimum)
    edge = np.zeros(near - 1, hashes.dtype)
    return np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), near, np.maximum) == hashes)


def neighbours(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it and the next one after it with the same hash, or -1."""
    order = np.argsort(hashes, kind="stable")  # stable: the places of a hash ascend
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    before, after = np.full(len(places), -1, np.int32), np.full(len(places), -1, np.int32)
    before[order[same + 1]] = places[order[same]]
    after[order[same]] = places[order[same + 1]]
    return before, after


_ANCHORS = "owner long, key long, copies long, place int, hash long, before int, after int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_ANCHORS of the chosen windows of (owner, key, copies, text)."""
    words, rolling = Words(), Rolling()
    names = [x.split()[0] for x in _ANCHORS.split(", ")]

    def part(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        took = pa.array(np.repeat(rows, [len(x[0]) for x in found]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(i).take(took) for i in range(3)] + columns, names=names)

    for batch in batches:
        rows, found, held = [], [], 0
        for row, text in enumerate(batch.column(3)):
            hashes = words(text.as_py())[2]
            if len(hashes) >= PASSAGE:
                h = windows(hashes, ANCHOR, rolling)
                at = chosen(h, PASSAGE - ANCHOR + 1).astype(np.int32)
                rows.append(row)
                found.append((at, h[at].view(np.int64), *neighbours(h[at], at)))
                held += len(at)
                if held > _HELD:
                    yield part(batch, rows, found)
                    rows, found, held = [], [], 0
        if rows:
            yield part(batch, rows, found)
    tidy()


_ENDS = pa.schema(
    [("owner", pa.int64()), ("key", pa.int64()), ("at", pa.int64())]
    + [(n, pa.list_(t)) for n, t in (("words", pa.int64()), ("chars", pa.int64()), ("lines", pa.int64()))]
)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands around the places of (owner, key, text, places), as _ENDS.

    A place is 2 * p for the words before word p, 2 * p + 1 for word p and those after it, up
    to ANCHOR of them, the nearest first. chars and lines are where a run begins (or ends)
    that has none, one, two ... of these words.
    """
    words = Words()

    def found() -> Iterator[tuple]:
        for batch in batches:
            for owner, key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                starts, ends, hashes = words(text)
                hashes, points = hashes.view(np.int64), code_points(text)
                breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
                for code in places:
                    p, after = code >> 1, code & 1
                    if after:
                        near, at = hashes[p : p + ANCHOR], ends[p - 1 : p + ANCHOR]
                    else:
                        low = max(0, p - ANCHOR)
                        near, at = hashes[low:p][::-1], starts[low : p + 1][::-1]
                    chars = at if points is None else points[at]
                    yield owner, key, code, near.tolist(), chars.tolist(), np.searchsorted(breaks, at).tolist()

    yield from _batches(found(), _ENDS)
    tidy()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, para, start, end) of each text of (doc_id, key, text) that has PASSAGE words, from its first word to its last."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "key", "para", "start", "end")])

    def found() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                if len(text) >= 2 * PASSAGE - 1 and len(text.encode().split()) >= PASSAGE:
                    plain = text.strip(" \t\n\r\x0b\x0c")
                    start = text.index(plain)
                    yield doc_id, key, text.count("\n", 0, start), start, start + len(plain)

    yield from _batches(found(), schema)


def _copies(rows: DataFrame) -> DataFrame:
    """(k, z, owner, copies, n) of each text that several rows have: its first id and how many
    ids and rows there are."""
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))
    groups = rows.groupBy("key", "doc_id").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("k"))
    groups = groups.agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.sum("c").alias("n")).filter("n > 1")
    return materialize(groups.select("k", F.col("first.id").alias("owner"), "copies"), "passage-copies")


def _same(a: str, b: str, of: str = "key") -> Column:
    """That two texts, named by their first id and their key, are one."""
    return (F.col(f"{a}{of}") == F.col(f"{b}{of}")) & F.col(f"{a}owner").eqNullSafe(F.col(f"{b}owner"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each run of words that repeats, in its own text or another.

    A run of ``PASSAGE`` words or more that stands anywhere else is met by a row; rows have
    ``ANCHOR`` words or more, which repeat word for word. Columns are those of
    ``repeated_paragraphs``; para and class_para are the lines in which the run and the copy
    it was compared with start: the last before it in its own text, else the first by id (null
    ids last) and place, or for the first itself, which is not removed, its own. A text that other documents have as a whole is
    one passage of each of them, and its parts that other texts have are told of its first
    document alone. A run ends where the chosen windows' first copies no longer follow each
    other, so rows of a text can overlap; n_in_class is the number of documents that have the
    run's most frequent window, or 2 for one that its own text has before. Rows of ``df`` that repeat with their id count as one
    document. Null text has no passage; an empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    groups = _copies(rows)
    copied = marked(groups.select(F.col("k").alias("key")), "key")

    # texts as wholes
    whole = rows.filter(copied).select("doc_id", "key", "text").mapInArrow(_whole, "doc_id long, key long, para long, start long, end long").distinct()
    whole = whole.join(groups.filter("copies > 1"), F.col("key") == F.col("k")).select(
        "doc_id", "para", "start", "end", F.col("owner").alias("class_id"), F.col("para").alias("class_para"), F.col("copies").alias("n_in_class"),
        (~F.col("doc_id").eqNullSafe(F.col("owner"))).alias("removed"),
    )
    whole = materialize(whole, "passage-wholes")

    # different texts, each once
    single = rows.filter(~copied).select(F.col("doc_id").alias("owner"), "key", F.lit(1).cast("long").alias("copies"), "text")
    several = rows.filter(copied).join(groups.withColumnRenamed("owner", "first"), F.col("key") == F.col("k"), "left")
    several = several.filter(F.col("k").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("owner"), "key", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "text"
    )
    texts = single.unionByName(several.dropDuplicates(["owner", "key"]))

    # chosen windows that are in several texts, each with the first of them, the first with the last
    found = texts.select("owner", "key", "copies", F.col("text").cast("binary").alias("text"))
    found = materialize(found.mapInArrow(_anchors, _ANCHORS), "passage-anchors")
    new = F.col("before") < 0
    twice = materialize(found.filter(new).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "passage-hashes")
    again = materialize(found.filter(new & (marked(twice, "hash") | (F.col("after") >= 0))), "passage-again")
    order = F.struct(F.col("owner").isNull().alias("z"), "owner", "key", "place")
    places = again.groupBy(F.col("hash").alias("h")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("copies").alias("n"), F.count("*").alias("c"))
    places = materialize(places.filter("c > 1").drop("c"), "passage-firsts")
    across = again.join(places, F.col("hash") == F.col("h"), "left").filter(F.col("h").isNotNull() | (F.col("after") >= 0))
    across = across.withColumn("stays", F.coalesce(order == F.col("first"), F.lit(True)))
    next_ = F.struct(F.lit(False).alias("z"), "owner", "key", F.col("after").alias("place"))
    to = F.when(F.col("h").isNull(), next_).when(F.col("stays"), F.col("last")).otherwise(F.col("first"))
    across = across.withColumn("to", to).select(
        "owner", "key", "place", "stays", F.coalesce("n", F.lit(2)).cast("long").alias("n"),
        F.col("to.owner").alias("to_owner"), F.col("to.key").alias("to_key"), (F.col("to.place") - F.col("place")).alias("shift"),
    )
    # and those that the text itself has before: with the last one, so that a line said a thousand times is one run
    within = found.filter(~new).select(
        "owner", "key", "place", F.lit(False).alias("stays"), F.lit(2).cast("long").alias("n"), F.col("owner").alias("to_owner"), F.col("key").alias("to_key"),
        (F.col("before") - F.col("place")).alias("shift"),
    )
    linked = across.unionByName(within)

    # runs
    pair = ["owner", "key", "to_owner", "to_key", "shift", "stays"]
    each = Window.partitionBy(*pair).orderBy("place")
    gap = F.col("place") - F.lag("place").over(each) > ANCHOR
    runs = linked.withColumn("new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("run", F.sum("new").over(each))
    runs = runs.groupBy(*pair, "run").agg(F.min("place").cast("long").alias("a"), (F.max("place") + ANCHOR).cast("long").alias("b"), F.max("n").alias("n"))
    runs = materialize(runs.drop("run"), "passage-runs")
    discard(found, twice, again, places)

    # how far both texts agree before and after
    sides = runs.select("*", F.explode(F.array(F.col("a") * 2, F.col("b") * 2 + 1)).alias("at"))
    own = sides.select("owner", "key", "at")
    other = sides.select(F.col("to_owner").alias("owner"), F.col("to_key").alias("key"), (F.col("at") + F.col("shift") * 2).alias("at"))
    asked = materialize(own.unionByName(other).groupBy("owner", "key").agg(F.collect_set("at").alias("places")), "passage-asked")
    asked_texts = texts.filter(marked(asked, "key")).alias("t").join(asked.alias("q"), _same("t.", "q."))
    ends = asked_texts.select("t.owner", "t.key", F.col("t.text").cast("binary"), "q.places").mapInArrow(
        _ends, "owner long, key long, at long, words array<long>, chars array<long>, lines array<long>"
    )
    ends = materialize(ends, "passage-ends")
    here, there = ends.alias("h"), ends.alias("o")
    met = (
        sides.alias("s")
        .join(here, _same("s.", "h.") & (F.col("s.at") == F.col("h.at")))
        .join(
            there,
            (F.col("s.to_key") == F.col("o.key")) & F.col("s.to_owner").eqNullSafe(F.col("o.owner")) & (F.col("s.at") + F.col("s.shift") * 2 == F.col("o.at")),
        )
    )
    differ = F.array_position(F.zip_with("h.words", "o.words", lambda x, y: ~x.eqNullSafe(y)), True)
    more = F.when(differ == 0, F.size("h.words")).otherwise(differ - 1).cast("int") + 1
    before = F.col("s.at") % 2 == 0
    spans = met.select(
        *[f"s.{c}" for c in pair], "s.a", "s.n", before.alias("before"), F.element_at("h.chars", more).alias("char"),
        F.element_at("h.lines", more).alias("line"), F.element_at("o.lines", more).alias("to_line"),
    )
    spans = spans.groupBy(*pair, "a").agg(
        F.max("n").alias("n_in_class"), *[F.max(F.when(F.col("before"), F.col(c))).alias(n) for c, n in (("char", "start"), ("line", "para"), ("to_line", "to_para"))],
        F.max(F.when(~F.col("before"), F.col("char"))).alias("end"),
    )
    stays = F.col("stays")
    parts = spans.select(
        F.col("owner").alias("doc_id"), "para", "start", "end", F.when(stays, F.col("owner")).otherwise(F.col("to_owner")).alias("class_id"),
        F.when(stays, F.col("para")).otherwise(F.col("to_para")).alias("class_para"), "n_in_class", (~stays).alias("removed"),
    )
    parts = parts.groupBy("doc_id", "para", "start", "end", "class_id", "class_para", "removed").agg(F.max("n_in_class").alias("n_in_class"))
    parts = materialize(parts.select(whole.columns), "passage-parts")
    discard(runs, asked, ends, groups)
    return parts.unionByName(whole)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All that repeats: near copies of paragraphs of ``min_words`` words or more, and passages
    across line ends. kind tells which a row is; a text's rows of the two kinds can overlap."""
    passages = repeated_passages(df, id_col, text_col).withColumn("kind", F.lit("passage"))
    return repeated_paragraphs(df, id_col, text_col, min_words).withColumn("kind", F.lit("paragraph")).unionByName(passages)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with removed paragraphs cut out of their texts, all columns kept."""
    gone = repeated_paragraphs(df, id_col, text_col, **options).filter("removed")
    per = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.col("para").cast("int")).alias("__gone"))
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    joined = packed.join(per, F.col("id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col("row")[text_col], "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    row = F.when(F.col("__gone").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, kept))
    return joined.select(row.alias("row")).select("row.*")
