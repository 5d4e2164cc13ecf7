"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 bytes of its lower-case letters, with one space for whatever stands
between them. The network runs over windows of the text in both directions, keeps its state
across the gaps between words, and labels every byte position, gaps too, with probabilities
over the languages. A document's probabilities are the mean over the positions of all its
windows. Training is backpropagation through time in numpy, on a bounded sample of labelled
rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_batches, text_or_empty, tidy

#: Bounds of the training sample: documents a language and windows a document, which are
#: spread over the whole text.
DOCS_PER_LANG, WINDOWS_PER_DOC = 300, 8
HIDDEN, EPOCHS, BATCH, RATE = 16, 3, 64, 0.01
#: Bytes of a window in prediction and in training; the state starts anew with each window.
WINDOW, TRAIN_WINDOW = 128, 64
#: Windows that are evaluated together.
TOGETHER = 1024
UND = "und"
_GAP = re.compile(r"[\W\d_]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """``langs`` and weights: input tables, recurrent matrices and output layer."""

    langs: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(langs)))
        w["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def _states(self, x: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """The states of one direction after each position, shape (length, words, hidden)."""
        wx, u = self.weights["x" + d], self.weights["u" + d]
        n, length = x.shape
        k = u.shape[0]
        h = np.zeros((n, k), wx.dtype)
        out = np.empty((length, n, k), wx.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, g = wx[x[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            if tape is not None:
                tape.append((t, h, z, r, c, g[:, 2 * k :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def positions(self, x: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each position, shape (length, words, languages), and the states."""
        f, b = tapes or (None, None)
        states = np.concatenate((self._states(x, "f", f), self._states(x, "b", b)), axis=2)
        logits = states @ self.weights["o"] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=2, keepdims=True), states

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross entropy of all positions, and that mean."""
        tapes: tuple[list, list] = ([], [])
        p, states = self.positions(x, tapes)
        length, n, _ = p.shape
        rows = np.arange(n)
        loss = float(-np.log(np.maximum(p[:, rows, y], 1e-12)).mean())
        dl = p.copy()
        dl[:, rows, y] -= 1
        dl /= length * n
        k = states.shape[2] // 2
        grads = {"o": np.einsum("tnh,tnl->hl", states, dl), "c": dl.sum((0, 1))}
        ds = dl @ self.weights["o"].T
        for d, tape, part in (("f", tapes[0], ds[:, :, :k]), ("b", tapes[1], ds[:, :, k:])):
            u = self.weights["u" + d]
            du, dx = np.zeros_like(u), np.zeros_like(self.weights["x" + d])
            dh = np.zeros((n, k), u.dtype)
            for t, h, z, r, c, g in reversed(tape):
                dh = dh + part[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * g * r * (1 - r)
                dg = np.concatenate((dz, dr, dc * r), axis=1)
                da = np.concatenate((dz, dr, dc), axis=1)
                one_hot = np.zeros((n, 256), u.dtype)
                one_hot[rows, x[:, t]] = 1
                dx += one_hot.T @ da
                du += h.T @ dg
                dh = dh * z + dg @ u.T
            grads["x" + d], grads["u" + d] = dx, du
        return grads, loss

    def pooled(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each window the sum of its positions' probabilities, shape (windows, languages).

        ``x`` is (windows, WINDOW) bytes, of which the first ``sizes`` of each are read. The
        same as summing ``positions`` of each window alone; here a feature is a row, so that
        all windows advance a position in one step.
        """
        n, length = x.shape
        xt = np.ascontiguousarray(x.T)
        on = (np.arange(length)[:, None] < sizes).astype(np.float32)
        short = int(sizes.min(initial=length))
        k = len(self.weights["uf"])
        out, c = np.ascontiguousarray(self.weights["o"].T), self.weights["c"][:, None]

        def run(d: str, steps: range) -> Iterator[tuple[int, np.ndarray]]:
            wx, u = np.ascontiguousarray(self.weights["x" + d].T), np.ascontiguousarray(self.weights["u" + d].T)
            h = np.zeros((k, n), np.float32)
            for t in steps:
                a, g = np.take(wx, xt[t], axis=1), u @ h
                zr = a[: 2 * k]
                zr += g[: 2 * k]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                new = g[2 * k :]
                new *= zr[k:]
                new += a[2 * k :]
                np.tanh(new, out=new)
                h -= new
                h *= zr[:k]
                h += new
                if t >= short:
                    h *= on[t]  # a window's state is zero beyond its end
                yield t, h

        ahead = np.empty((length, k, n), np.float32)
        for t, h in run("f", range(length)):
            ahead[t] = h
        sums = np.zeros((len(self.langs), n), np.float32)
        for t, h in run("b", range(length - 1, -1, -1)):
            p = out[:, :k] @ ahead[t]
            p += out[:, k:] @ h
            p += c
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if t >= short:
                p *= on[t]
            sums += p
        return sums.T


def letters(text: str) -> bytes:
    """The text's letters in lower case, a space for each gap, as UTF-8; no letter: empty."""
    plain = _GAP.sub(" ", text.lower()).strip(" ")
    if not plain.replace(" ", "").isalpha():  # numerals that are no digits pass for word characters
        plain = " ".join("".join(x if x.isalpha() else " " for x in plain).split())
    return plain.encode("utf-8")


def windows(data: bytes, size: int) -> list[bytes]:
    """``data`` in parts of at most ``size`` bytes that end with whole characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit a model to (window, language) pairs with Adam. Each language weighs the same."""
    langs = sorted({lang for _, lang in samples})
    model = Model.fresh(langs, seed=seed)
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for window, lang in samples:
        by_lang[lang].append(window)
    most = max(map(len, by_lang.values()), default=0)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for i, lang in enumerate(langs):
        own = by_lang[lang]
        for j in range(most if own else 0):
            by_length.setdefault(len(own[j % len(own)]), []).append((own[j % len(own)], i))
    data = {
        n: (np.frombuffer(b"".join(x for x, _ in rows), np.uint8).reshape(-1, n), np.array([y for _, y in rows]))
        for n, rows in sorted(by_length.items())
    }
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    total = max(1, epochs * sum(-(-len(y) // BATCH) for _, y in data.values()))
    for _ in range(epochs):
        batches = []
        for n, (_, y) in data.items():
            order = rng.permutation(len(y))
            batches += [(n, order[i : i + BATCH]) for i in range(0, len(y), BATCH)]
        for b in rng.permutation(len(batches)):
            n, rows = batches[b]
            x, y = data[n]
            grads, _ = model.gradients(x[rows], y[rows])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-12))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


class Pool:
    """Collects the windows of texts, evaluates them TOGETHER at a time, and names languages.

    Batches are always filled up to the same shape, so that a window's values do not depend
    on what it is evaluated with.
    """

    def __init__(self, model: Model, texts: int):
        self.model = model
        self.sums = np.zeros((texts, len(model.langs)))
        self.sizes = np.zeros(texts, np.int64)
        self.x = np.zeros((TOGETHER, WINDOW), np.uint8)
        self.held: list[tuple[int, int]] = []

    def add(self, i: int, data: bytes) -> None:
        self.sizes[i] = len(data)
        for part in windows(data, WINDOW):
            self.x[len(self.held), : len(part)] = np.frombuffer(part, np.uint8)
            self.held.append((i, len(part)))
            if len(self.held) == TOGETHER:
                self.flush()

    def flush(self) -> None:
        if self.held and self.model.langs:
            sizes = np.zeros(TOGETHER, np.int64)
            sizes[: len(self.held)] = [n for _, n in self.held]
            found = self.model.pooled(self.x, sizes)[: len(self.held)]
            np.add.at(self.sums, [i for i, _ in self.held], found)
        self.held = []

    def named(self) -> tuple[list[str], list[float]]:
        """The languages with the largest mean probability over all positions, and these means."""
        self.flush()
        langs, scores = [], []
        for total, size in zip(self.sums, self.sizes.tolist(), strict=True):
            if size == 0 or not self.model.langs:
                langs.append(UND)
                scores.append(0.0)
            else:
                best = int(total.argmax())
                langs.append(self.model.langs[best])
                scores.append(min(1.0, max(0.0, float(total[best]) / size)))
        return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id's text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_windows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG,
    windows_per_doc: int = WINDOWS_PER_DOC,
) -> list[tuple[bytes, str]]:
    """(window, language) pairs of a bounded sample of labelled rows that are not held out.

    Of each language about ``docs_per_lang`` rows are taken, those whose hash of the id falls
    below the share that its count leaves, and of each ``windows_per_doc`` windows at even
    distances over the whole text. Where ids repeat, the sample stops at four times its
    size, in an order that the rows' hashes give.
    """
    rows = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text")
    )
    # a row a language: bounded by the label set
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    cuts = {lang: math.ceil(min(1.0, docs_per_lang / n) * (1 << 30)) for lang, n in counts.items()}

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                found = windows(letters(text.as_py()), TRAIN_WINDOW)
                at = {int(i * len(found) / windows_per_doc) for i in range(windows_per_doc)} if found else ()
                out.append([found[i] for i in sorted(at)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "windows"]
            )

    cut = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
    picked = rows.filter(F.col("h") < cut[F.col("lang")])
    sample = picked.select("lang", "h", "text").mapInArrow(some, "lang string, h long, windows array<binary>")
    sample = sample.orderBy("h", "lang", "windows").limit(4 * docs_per_lang * len(cuts)).collect()
    return sorted((bytes(w), r["lang"]) for r in sample for w in r["windows"])


def predict(df: DataFrame, model: Model, text_col: str | Column = "text") -> DataFrame:
    """All columns of ``df`` but those named lang_pred and score, and these two.

    lang_pred is the language with the largest mean probability over every position of the
    whole text, score that mean; ``und`` and 0 if text is null or has no letter, or if no
    language was learned. Prediction reads nothing but the text, and only the text goes
    through Python.
    """
    text_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]

    @F.arrow_udf("lang_pred string, score double")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pool = Pool(model, len(batch))
            for i, text in enumerate(batch):
                if data := letters(text.as_py()):
                    pool.add(i, data)
            langs, scores = pool.named()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
        tidy()

    packed = df.select(F.struct(*kept).alias("row"), named(text_or_empty(text_col)).alias("found"))
    return packed.select("row.*", "found.lang_pred", "found.score")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_on: DataFrame | None = None) -> DataFrame:
    """Train on the labelled rows of ``train_on`` (``df`` by default) and predict all of ``df``.

    One row per input row: doc_id, held_out, lang_pred, score. An empty table, or one
    without labels, teaches no language, and every row is ``und``. Null ids are not held
    out. Repeated rows get equal values. Other columns are ignored.
    """
    source = train_on if train_on is not None else df
    model = train(training_windows(source, id_col, text_col, lang_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return predict(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found, with all their columns; ``und`` rows go.

    These have null text or no letter. Where no row is labelled, rows with a letter stay.
    Repeated rows are kept or go together; an empty table stays empty.
    """
    model = train(training_windows(df, id_col, text_col, lang_col))
    if not model.langs:
        return df.filter(text_or_empty(text_col).rlike(r"\p{L}"))
    packed = df.select(F.struct(*df.columns).alias("row"))
    return predict(packed, model, F.col("row")[text_col]).filter(F.col("lang_pred") != UND).select("row.*")
