"""BPE encoding and decoding.

A word is a doubly linked list of symbols. A priority queue holds the ranks of the pairs
that could merge; an entry whose symbols have changed since is stale and skipped. Decoding
concatenates vocabulary strings. Words repeat, so each worker keeps the ids of words it
has seen lately as bytes, up to a fixed number of words and of bytes a word.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_batches, text_or_empty, tidy

#: Words in a generation of the words whose ids a worker remembers, and characters of the
#: longest one: two generations of such words take about 60 MB.
CACHE_WORDS, CACHE_CHARS = 150_000, 32
#: Bytes of text whose ids are held at a time; a longer text is a part of its own.
PART_BYTES = 2 << 20
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent:
    """The last words asked for: two generations of at most CACHE_WORDS each."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        if (ids := self.new.get(word)) is None and (ids := self.old.get(word)) is not None:
            self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> bytes:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        if len(word) <= CACHE_CHARS:
            self.new[word] = ids
        return ids


class Codec:
    """A word-level BPE: normalised to NFC and lower case, split by a pattern, with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = vocab | self.special
        self.strings = [""] * (max(named.values()) + 1)
        for text, i in named.items():
            self.strings[i] = text
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.suffix] for b in range(256)]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("a pair's key holds two ids of 16 bits")
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], rank << 16 | vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # a chunk has no white space, so the pattern's \s need not be told from other characters
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", ""))
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = tuple(self.special)
        self.cache = Recent()

    def merge(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        n = len(data)
        if n == 1:
            return (self.last[data[0]],)
        first, get = self.first, self.ranks.get
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        queue = []
        for i in range(n - 1):
            if (r := get(ids[i] << 16 | ids[i + 1])) is not None:
                queue.append((r >> 16 << 32 | i) << 16 | (r & 65535))
        if not queue:
            return tuple(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry >> 16 & 0xFFFFFFFF
            j = after[i]
            if j >= n or (a := ids[i]) < 0 or (r := get(a << 16 | ids[j])) is None or r >> 16 != entry >> 48:
                continue  # stale: the symbols are no longer the pair of this rank
            new = entry & 65535
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 16 | ids[k])) is not None:
                    heapq.heappush(queue, (r >> 16 << 32 | i) << 16 | (r & 65535))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 16 | new)) is not None:
                heapq.heappush(queue, (r >> 16 << 32 | h) << 16 | (r & 65535))
        return tuple([x for x in ids if x >= 0])

    def _word(self, word: str) -> bytes:
        """The ids of a word. A word of letters is also a chunk, and so kept among these."""
        if (ids := self.cache.get(word)) is None:
            ids = array("I", self.merge(word)).tobytes()
            if word.isalpha():
                self.cache.put(word, ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            plain = chunk.lower()
        else:  # letter by letter: no final sigma
            plain = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        if plain.isalpha():
            return self._word(plain)
        if plain[-1] in ".,;:!?" and plain[:-1].isalpha():
            words = (plain[:-1], plain[-1])
        else:
            words = self.pattern.findall(plain)
        return b"".join([self._word(word) for word in words])

    def _plain(self, text: str) -> bytes:
        chunks = [x for x in _GAP.split(text) if x] if _CONTROL.search(text) else text.split()
        out: list[bytes] = []
        cache = self.cache
        get = cache.new.get
        for chunk in chunks:
            if (ids := get(chunk)) is None:
                if (ids := cache.get(chunk)) is None:
                    ids = cache.put(chunk, self._chunk(chunk))
                get = cache.new.get
            out.append(ids)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special_split.split(text)
        return b"".join([array("I", (self.special[x],)).tobytes() if x in self.special else self._plain(x) for x in parts])

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings one after the other. The vocabulary declares no decoder, so a
        space stands between them and word ends stay."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.cache
def codec_of(path: str) -> Codec:
    """One codec a worker process: tasks that follow find its words."""
    return Codec(path)


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    ``vocabulary`` is the path of a tokenizer file that every executor can read. Whole
    texts are encoded and decoded again from the ids; null is empty and has no tokens.
    ids_sha256 covers the ids as little-endian unsigned 32-bit integers. Repeated rows
    each get a row. Other columns are ignored.
    """

    def encoded(part: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        counts, id_sums, text_sums, kept = [], [], [], bytearray()
        for value in part.column(1):
            packed = codec.packed(value.as_py())
            ids = array("I", packed)
            counts.append(len(ids))
            id_sums.append(hashlib.sha256(packed).hexdigest())
            text_sums.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            if keep_ids:
                kept += packed
        columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
            values = pa.Array.from_buffers(pa.int32(), len(kept) // 4, [None, pa.py_buffer(kept)])
            columns, names = [*columns, pa.ListArray.from_arrays(ends, values)], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            start = held = 0
            for at, n in enumerate(sizes):
                if at > start and held + n > PART_BYTES:
                    yield encoded(batch.slice(start, at - start), codec)
                    start, held = at, 0
                held += n
            if start < len(sizes):
                yield encoded(batch.slice(start), codec)
        tidy()

    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    )
