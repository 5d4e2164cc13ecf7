"""Media columns: bytes stored as motion-JPEG frames in AVI containers, and shots found in them.

A payload becomes 8-bit gray samples, 24 x 24 a frame. Each frame is a lossless JPEG
(ITU-T T.81, process 14, SOF3: the left neighbour predicts, differences are Huffman-coded),
so decoding gives back every sample. The container is RIFF AVI with an index of frames. The
reader follows that index, decodes the frames, and cuts shots where the distance between
the histograms of neighbours stands out from the distances around it.

Coding works on many frames at once: arrays run over the frames of a batch, and only the
576 samples of a frame are a loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
FPS = 25
#: Frames coded at a time; a longer document is coded in several goes.
FRAMES_AT_ONCE = 2048
#: Code lengths of T.81 table K.3 (1 to 16 bits), for categories 0 to 11.
CODE_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
#: A shot starts where the histogram distance exceeds the mean of the distances within
#: WINDOW frames by SIGMAS standard deviations and is at least LEAST (of 2).
BINS, WINDOW, SIGMAS, LEAST = 32, 12, 1.5, 0.25


def _codes(counts: tuple[int, ...]) -> list[tuple[int, int]]:
    """(code, bits) of each symbol in turn: the canonical codes of a Huffman table."""
    out, code = [], 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, bits))
            code += 1
        code <<= 1
    return out


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255."""
    codes = _codes(CODE_COUNTS)
    bits, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], length[d + 255] = code << cat | extra, n + cat
    return bits, length


_BITS, _LENGTH = _encode_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes((1, 0x11, 0)))
    + _segment(0xC4, bytes((0, *CODE_COUNTS, *range(sum(CODE_COUNTS)))))
    + _segment(0xDA, bytes((1, 1, 0x00, 1, 0, 0)))
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of ``samples``, uint8 of shape (frames, FRAME)."""
    n = len(samples)
    if not n:
        return []
    s = samples.reshape(n, HEIGHT, WIDTH).astype(np.int16)
    diff = np.empty_like(s)
    diff[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    diff[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    diff[:, 0, 0] = s[:, 0, 0] - 128
    index = diff.reshape(n, FRAME) + 255
    bits, length = _BITS[index], _LENGTH[index]
    ends = np.cumsum(length, axis=1)
    total = ends[:, -1]
    size = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = (start[:, None] * 8 + ends - length).ravel()
    spread = (bits.ravel().astype(np.int64) << (24 - length.ravel() - (at & 7)))
    first = at >> 3
    stop = int(start[-1] + size[-1])
    data = np.zeros(stop + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):  # no two codes share a bit, so sums are unions
        data[: stop + 3] += np.bincount(first + k, weights=(spread >> shift) & 255, minlength=stop + 3).astype(np.int64)
    data[start + size - 1] |= (1 << (size * 8 - total)) - 1  # the last byte is filled up with ones
    data = data[:stop].astype(np.uint8)
    full = np.flatnonzero(data == 255)
    stuffed = np.insert(data, full + 1, 0).tobytes()
    moved = start + np.searchsorted(full, start)
    edges = [*moved.tolist(), len(stuffed)]
    return [_HEAD + stuffed[a:b] + b"\xff\xd9" for a, b in zip(edges, edges[1:], strict=False)]


def _header(frame: bytes) -> tuple[int, bytes, int]:
    """(where the coded samples start, table segment, predictor); other forms are refused."""
    at, table = 2, b""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        mark, marker, n = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + n]
        if mark != 0xFF:
            raise ValueError("marker expected")
        if marker == 0xC3:
            if struct.unpack(">BHHB", body[:6]) != (8, HEIGHT, WIDTH, 1):
                raise ValueError("frame of another form")
        elif marker == 0xC4:
            table = body
        elif marker == 0xDA:
            return at + 2 + n, table, body[3]
        at += 2 + n


_TABLES: dict[bytes, np.ndarray] = {}


def _decode_table(segment: bytes) -> np.ndarray:
    """For each 16 bits ahead: the difference they start with (+ 512) x 32 + the bits it takes."""
    if segment not in _TABLES:
        table = np.zeros(1 << 16, np.int32)
        counts, symbols = tuple(segment[1:17]), segment[17:]
        for (code, n), cat in zip(_codes(counts), symbols, strict=True):
            if n + cat > 16 or cat > 8:
                continue  # no difference of 8-bit samples
            for extra in range(1 << cat):
                d = extra if not cat or extra >> (cat - 1) else extra - (1 << cat) + 1
                low = (code << cat | extra) << (16 - n - cat)
                table[low : low + (1 << (16 - n - cat))] = (d + 512) * 32 + n + cat
        _TABLES[segment] = table
    return _TABLES[segment]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of lossless frames, uint8 of shape (frames, FRAME)."""
    n = len(frames)
    out = np.empty((n, FRAME), np.uint8)
    if not n:
        return out
    heads: dict[bytes, tuple[int, bytes, int]] = {}
    parts = []
    for f in frames:
        if (h := f[: len(_HEAD)]) not in heads:
            heads[h] = _header(f)
        parts.append(f[heads[h][0] : -2])
    if len({h[1:] for h in heads.values()}) != 1 or next(iter(heads.values()))[2] != 1:
        raise ValueError("frames of one stream share their table and predictor 1")
    table = _decode_table(next(iter(heads.values()))[1])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    stuffed = np.flatnonzero(raw[:-1] == 255) + 1
    stuffed = stuffed[raw[stuffed] == 0]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    starts = starts - np.searchsorted(stuffed, starts)
    data = np.concatenate((np.delete(raw, stuffed), np.zeros(4, np.uint8))).astype(np.uint32)
    ahead = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    at = starts * 8
    diff = np.empty((FRAME, n), np.int32)
    for i in range(FRAME):
        got = table[(ahead[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF]
        diff[i] = got >> 5
        at += got & 31
    if (diff == 0).any():
        raise ValueError("bits that are no code")
    d = (diff.T - 512).reshape(n, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(n, FRAME)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """A RIFF AVI of one motion-JPEG stream with an idx1 index."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        movi.append(c)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """The frames that the index names, in its order, and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    movi, index, fps = None, b"", FPS
    while at < end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST":
            fps = round(1_000_000 / struct.unpack_from("<I", data, data.index(b"avih", at) + 8)[0])
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no frames")
    frames = []
    for i in range(0, len(index), 16):
        offset, n = struct.unpack_from("<II", index, i + 8)
        start = movi + offset
        if data[start : start + 4] != index[i : i + 4]:
            raise ValueError("the index names a place where no chunk starts")
        frames.append(data[start + 8 : start + 8 + n])
    return frames, fps


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of each shot; a stream without a cut is one shot."""
    n = len(samples)
    rows = np.repeat(np.arange(n), samples.shape[1]) * BINS
    hist = np.bincount(rows + (samples.ravel() >> 3), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    if not len(d):
        return [(0, n)]
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (d, d * d))
    lo = np.maximum(np.arange(len(d)) - WINDOW, 0)
    hi = np.minimum(np.arange(len(d)) + WINDOW + 1, len(d))
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    sd = np.sqrt(np.maximum((squares[hi] - squares[lo]) / (hi - lo) - mean * mean, 0))
    cuts = (np.flatnonzero((d > mean + SIGMAS * sd) & (d >= LEAST)) + 1).tolist()
    edges = [0, *cuts, n]
    return list(zip(edges, edges[1:], strict=False))


def padded(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items whose frames add up to FRAMES_AT_ONCE or so."""
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > FRAMES_AT_ONCE:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload, whose length is a multiple of a frame."""
    out: list[bytes] = []
    sizes = [len(p) // FRAME for p in payloads]
    for a, b in _slices(sizes):
        samples = np.frombuffer(b"".join(payloads[a:b]), np.uint8).reshape(-1, FRAME)
        frames: list[bytes] = []
        for i in range(0, len(samples), FRAMES_AT_ONCE):
            frames += encode_frames(samples[i : i + FRAMES_AT_ONCE])
        at = 0
        for n in sizes[a:b]:
            out.append(write_avi(frames[at : at + n]))
            at += n
    return out


def decode_media(files: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """The samples and frames a second of each file."""
    for a, b in _slices([len(f) // FRAME for f in files]):
        streams = [read_avi(f) for f in files[a:b]]
        frames = [f for s, _ in streams for f in s]
        parts = [decode_frames(frames[i : i + FRAMES_AT_ONCE]) for i in range(0, len(frames), FRAMES_AT_ONCE)]
        samples = np.concatenate(parts) if parts else np.empty((0, FRAME), np.uint8)
        at = 0
        for s, fps in streams:
            yield samples[at : at + len(s)], fps
            at += len(s)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes and media, the text's AVI file. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 1):
                data = [x.as_py() for x in part.column(1)]
                media = pa.array(encode_media([padded(x) for x in data]), pa.binary())
                sizes = pa.array([len(x) for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, media], names=["doc_id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of a column; a larger value is a part of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield batch.slice(a, b - a)
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield batch.slice(a)


def read_media(media: DataFrame) -> DataFrame:
    """Read the files back: doc_id, n_bytes, digests of payload and file, and clips.

    clips is an array of (clip, start_ms, end_ms, first_frame, end_frame), a timed row for
    each shot; feature lists them as text. Equal files give equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([(n, pa.int64()) for n in ("clip", "start_ms", "end_ms", "first_frame", "end_frame")]))
        for batch in batches:
            for part in _pieces(batch, 2):
                files = [x.as_py() for x in part.column(2)]
                size, sha, crc, clips, feature = [], [], [], [], []
                for samples, fps in decode_media(files):
                    payload = samples.tobytes()
                    size.append(len(payload))
                    sha.append(hashlib.sha256(payload).hexdigest())
                    crc.append(zlib.crc32(payload[-32:]))
                    rows = [
                        {"clip": i, "start_ms": 1000 * a // fps, "end_ms": 1000 * b // fps, "first_frame": a, "end_frame": b}
                        for i, (a, b) in enumerate(shots(samples))
                    ]
                    clips.append(rows)
                    feature.append(",".join(f"{r['start_ms']}-{r['end_ms']}" for r in rows))
                columns = {
                    "doc_id": part.column(0),
                    "n_bytes": part.column(1),
                    "payload_bytes": pa.array(size, pa.int64()),
                    "payload_sha256": pa.array(sha, pa.string()),
                    "tail_crc32": pa.array(crc, pa.int64()),
                    "media_bytes": pa.array([len(f) for f in files], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    "feature": pa.array(feature, pa.string()),
                    "clips": pa.array(clips, clip),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, "
        "clips array<struct<clip:long,start_ms:long,end_ms:long,first_frame:long,end_frame:long>>"
    )
    return media.mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, start_ms, end_ms, first_frame, end_frame."""
    return read_media(media).select("doc_id", F.inline("clips"))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media and read it back, without ``clips``. Empty in, empty out."""
    return read_media(to_media(df, id_col, text_col)).drop("clips")
