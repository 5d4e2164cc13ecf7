"""WARC archives and a globally ordered capture index.

Records are written as archives by Spark's own text writer (a record is UTF-8 and ends in
a line feed), so any store that Spark can write holds them. Reading them back, each task
makes locally sorted capture runs, one an archive. The runs are then merged: rows are dealt
by ranges of (URL key, timestamp, page id), which splits a hot URL key too, and each range
merges its slices of all runs with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, new_path, text_or_empty

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of records an archive aims at, and may have if all its records are of the largest size.
ARCHIVE_BYTES, ARCHIVE_LIMIT = 16 << 20, 256 << 20
#: Capture time of page 0; without a capture time of its own, page n follows n seconds later.
EPOCH = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

INDEX_SCHEMA = (
    "run string, urlkey string, ts string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, url string, archive string, offset long, length long"
)


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: 160 bits are 8 groups of 20, each 4 letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def _header_safe(col: Column) -> Column:
    """Header values hold no line breaks: these and the percent sign are percent-encoded."""
    col = F.replace(col, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(col, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write one record per row into gzip-compressed archives under ``path``.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at
    least ``min_bytes``, the one with the largest id is a response, and the others are
    revisit records without a payload that refer to it; smaller ones are all responses.
    Null ids count as smaller than all others; where only null ids share a payload, or
    several rows carry the largest id, each of these is a response. A null URL leaves its
    header out.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html")
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    last = (
        rows.filter(size >= min_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("last"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), "last")
    )
    rows = rows.join(materialize(last, "warc-equal"), (F.col("digest") == F.col("d")) & (size >= min_bytes), "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    when = F.date_format(
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.coalesce("id", F.lit(0)) % 1_000_000_000),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))).otherwise(F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", _header_safe(F.col("url"))),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("last")))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
        F.lit(CRLF + "\r"),  # the writer's line end completes the last CRLF
    )
    lengths = df.agg(
        F.avg(F.octet_length(text_or_empty(html_col))).alias("mean"), F.max(F.octet_length(text_or_empty(html_col))).alias("most")
    ).first()
    head = 600
    per_file = min(ARCHIVE_BYTES // int((lengths["mean"] or 0) + head), ARCHIVE_LIMIT // int((lengths["most"] or 0) + head))
    (
        rows.select(record.alias("value"))
        .write.option("lineSep", "\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, per_file))
        .text(path)
    )


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, no scheme, no ``www.``, no fragment, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/")
    return (key + ("?" + parts.query if parts.query else "")).lower()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an uncompressed archive."""
    at, end = 0, len(data)
    while at < end:
        top = data.index(b"\r\n\r\n", at)
        lines = data[at:top].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        block = data[top + 4 : top + 4 + n]
        if len(block) != n or data[top + 4 + n : top + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} is cut off")
        yield headers, block, at, top + 8 + n - at
        at = top + 8 + n


def _id(urn: str | None) -> int | None:
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None


def _capture(archive: str, headers: dict[str, str], block: bytes, offset: int, length: int) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, url = headers["WARC-Type"], headers.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {headers.get('WARC-Record-ID')} does not match its digest")
    else:
        told = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = int(told[0].split(b":")[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = _id(headers.get("WARC-Refers-To"))
    return (
        archive, url_key(url), headers["WARC-Date"], _id(headers.get("WARC-Record-ID")), kind, refers, size, digest, url, archive, offset, length,
    )


_ARROW = pa.schema(
    [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX_SCHEMA.split(", "))]
)


def _key(row: dict) -> tuple:
    page = row["page_id"]
    return row["urlkey"], row["ts"], page is not None, page or 0, row["archive"], row["offset"]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``: each archive's rows sorted, together, one run."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                short = name.rsplit("/", 1)[1]
                rows = [dict(zip(_ARROW.names, _capture(short, *r), strict=True)) for r in records(data)]
                rows.sort(key=_key)
                yield from pa.Table.from_pylist(rows, _ARROW).to_batches(max_chunksize=10_000)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, INDEX_SCHEMA)


#: Captures of a range that one task merges.
RANGE_ROWS = 200_000


class LoserTree:
    """k-way merge of sorted sequences of (key, item): the winner's path is replayed against losers."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k  # tree[0]: the winner, the others: losers
        for i in range(len(runs)):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # an open seat wins while the tree fills
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _replay(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at > 0:
            if self._less(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _merge_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    run, urlkey, ts, page = (table.column(n).to_pylist() for n in ("run", "urlkey", "ts", "page_id"))
    offset = table.column("offset").to_pylist()
    edges = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]

    def cursor(a: int, b: int) -> Iterator[tuple]:
        for i in range(a, b):
            yield (urlkey[i], ts[i], page[i] is not None, page[i] or 0, run[i], offset[i]), i

    runs = [cursor(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    merged = table.take(pa.array([i for _, i in LoserTree(runs)], pa.int64()))
    merged = merged.append_column("position", pa.array(range(len(merged)), pa.int64()))
    yield from merged.to_batches(max_chunksize=10_000)


def merge_runs(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The captures in order of (urlkey, ts, page_id): by partition, then by position in it.

    Null ids come first among equal URL keys and times, and ties are in order of archive
    and offset. A range's rows are held as one Arrow table, so there are as many ranges as
    keep each at about RANGE_ROWS rows, unless ``partitions`` says how many.
    """
    least = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(least, -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(n, "urlkey", "ts", "page_id").sortWithinPartitions(
        "run", "urlkey", "ts", F.col("page_id").asc_nulls_first(), "offset"
    )
    return ranged.mapInArrow(_merge_part, INDEX_SCHEMA + ", position long")


def capture_index(df: DataFrame, **columns) -> DataFrame:
    """Write ``df``'s archives, read them back and merge their runs. Empty in, empty out."""
    spark = df.sparkSession
    path = new_path(spark, "warc")
    write_archives(df, path, **columns)
    return merge_runs(materialize(read_runs(spark, path), "warc-runs"))


ORACLE_SQL = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), "
    "h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS s FROM p), "
    "d AS (SELECT page_id, payload_bytes, concat("
    + ", ".join(
        f"substr('{ALPHABET}', 1 + ((('0x' || substr(s, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
        for i in range(8)
        for shift in (15, 10, 5, 0)
    )
    + ") AS payload_digest FROM h), "
    "m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d) "
    "SELECT page_id, payload_bytes, payload_digest, "
    "CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> last THEN last END AS refers_to FROM m"
)
