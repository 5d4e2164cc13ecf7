"""Personal data: patterns propose spans, validators confirm them, context scores them.

The patterns of the base kinds are applied leftmost and without overlap within a kind.
They are written so that a long run of characters costs time in proportion to its length:
an address is found from its ``@``, and runs of digits are matched without giving back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: Characters before and after a span in which context words count.
CONTEXT = 48
#: Spans of the added kinds below this score are not reported.
THRESHOLD = 0.5
#: kind: (score when valid, words that raise it, words that lower it)
SCORES = {
    "email": (0.9, r"mail|contact|write", r"example"),
    "ip": (0.6, r"\bip\b|address|host|server", r"version|section|chapter"),
    "card": (0.8, r"card|visa|credit|payment", r"serial|isbn|order"),
    "phone": (0.7, r"phone|call|tel|mobile|fax", r"serial|order"),
    "iban": (0.8, r"iban|bank|account|konto|transfer", r"serial|hash"),
    "ssn": (0.3, r"\bssn\b|social security|tax", r"serial|order|part"),
    "secret": (0.4, r"passw|token|secret|key|credential|login", r"example|placeholder|checksum"),
}

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+))")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Registered lengths by country.
_IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 "
        "MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: An access key by its form, or what a name such as password is set to.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:passw(?:or)?d|token|secret|api[_-]?key)[\x20\"']{0,2}[=:][\x20\"']{0,2}(?P<value>[A-Za-z0-9+/_-]{12,}+))"
)
_UP = {k: re.compile(v[1], re.I) for k, v in SCORES.items()}
_DOWN = {k: re.compile(v[2], re.I) for k, v in SCORES.items()}
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before the ``@``, as far back as the last match's end."""
    end = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            end = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of digit groups joined by dots holds a match in each four of its groups."""
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, start + length
            start += length + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A run can reach into the next words: of each start the valid part up to the end of a word,
    the one of the country's length first and then the longest."""
    last = 0
    for m in _IBAN.finditer(text):
        start, end = m.span(1)
        if start < last:
            continue
        ends = []
        while end > start and (size := end - start - text.count(" ", start, end)) >= 15:
            if text[end : end + 1] not in _ALNUM:
                ends.append((size != _IBAN_LENGTH.get(text[start : start + 2]), -end))
            end = text.rfind(" ", start, end)
        for _, end in sorted(ends):
            if mod97(text[start:-end]):
                last = -end
                yield start, last
                break


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values that look drawn at random: letters and digits, eight different characters or more."""
    for m in _SECRET.finditer(text):
        start, end = m.span("value") if m["value"] else m.span()
        value = text[start:end]
        if len(set(value)) >= 8 and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            yield start, end


def _added(text: str) -> Iterator[tuple[int, int, str]]:
    for a, b in ibans(text):
        yield a, b, "iban"
    for a, b in secrets(text):
        # an access key is known by its form, a value by the name before it
        yield a, b, "secret"
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield *m.span(), "ssn"


def score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's base score, moved by context words within reach and kept in 0 to 1."""
    near = text[max(0, start - CONTEXT) : start] + "\0" + text[end : end + CONTEXT]
    base = 0.9 if kind == "secret" and text.startswith("AKIA", start) else SCORES[kind][0]
    value = base + 0.3 * bool(_UP[kind].search(near)) - 0.3 * bool(_DOWN[kind].search(near))
    return min(1.0, max(0.0, round(value, 3)))


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind. Base kinds are kept at any score."""
    spans = []
    if "@" in text:
        spans += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        spans += [(a, b, "ip") for a, b in ips(text)] + [(a, b, "card") for a, b in cards(text)]
        if "+" in text:
            spans += [(a, b, "phone") for a, b in phones(text)]
        spans += list(_added(text))
    scored = [(a, b, k, score(text, a, b, k)) for a, b, k in spans]
    kept = [x for x in scored if x[2] in KINDS[:4] or x[3] >= THRESHOLD]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and found, an array of (kind, start, end, score, match).

    Offsets are code points of the whole text, the end exclusive. Null and empty texts
    have no spans; repeated rows each get theirs. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())])
        )
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b, "score": s, "match": t[a:b]} for a, b, k, s in find(t)]
                for t in (x.as_py() for x in batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double,match:string>>")


def pii_digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts of the base kinds, their digest, all spans, how many
    these are, and the largest score among them (null: none)."""

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(rows):
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = F.filter("found", lambda x: x.kind.isin(*KINDS[:4]))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        F.array_max(F.transform("found", lambda x: x.score)).alias("max_score"),
    )


def masked(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlaps become one."""
    out, at = [], 0
    for a, b, kind, _ in find(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
