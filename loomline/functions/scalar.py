"""Scalar functions as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_number", "bounded_rate_count", "canonical_id", "canonical_json", "canonical_timestamp", "clean_category", "cyclic_next",
    "hash_index", "is_canonical_timestamp", "is_sha256_hex", "json_string", "min_max", "relative_change_percent", "relative_loss",
    "risk_level", "safe_divide", "set_jaccard", "sigmoid", "stable_hash", "temporal", "to_timestamp_or_null",
]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_number(col: str | Column) -> Column:
    """Numeric coercion: what is no finite number becomes null."""
    v = _c(col).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def to_timestamp_or_null(col: str | Column, fmt: str = "M/d/yyyy H:m") -> Column:
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def safe_divide(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def clean_category(col: str | Column) -> Column:
    """Null becomes the empty string; outer blanks go."""
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))


def temporal(col: str | Column, prefix: str = "") -> list[Column]:
    """year, month, day, day_of_week (Monday is 0), hour: null for a missing time; is_weekend: then 0."""
    c = _c(col)
    return [
        F.year(c).alias(prefix + "year"),
        F.month(c).alias(prefix + "month"),
        F.dayofmonth(c).alias(prefix + "day"),
        F.weekday(c).alias(prefix + "day_of_week"),
        F.hour(c).alias(prefix + "hour"),
        F.coalesce(F.weekday(c) >= 5, F.lit(False)).cast("int").alias(prefix + "is_weekend"),
    ]


def canonical_timestamp(col: str | Column) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_canonical_timestamp(col: str | Column) -> Column:
    c = _c(col)
    parsed = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    shape = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.coalesce(shape & canonical_timestamp(parsed).eqNullSafe(c), F.lit(False))


def is_sha256_hex(col: str | Column) -> Column:
    return F.coalesce(_c(col).rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_id(col: str | Column) -> Column:
    """A decimal integer without sign or leading zeros as a string; anything else is null."""
    c = F.trim(_c(col).cast("string"))
    return F.when(c.rlike("^(0|[1-9][0-9]*)$"), c)


def is_printable(col: str | Column) -> Column:
    """Whether all characters are printable ASCII."""
    return _c(col).rlike(r"^[\x20-\x7e]*\z")


def printable_json_string(col: str | Column) -> Column:
    """A JSON string, or null, of a text that is known to be printable ASCII."""
    c = F.replace(F.replace(_c(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def json_string(col: str | Column) -> Column:
    """A JSON string, or null. Characters beyond printable ASCII are escaped, those above
    U+FFFF as a pair of surrogates; only texts that have any take that way."""
    c = F.replace(F.replace(_c(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    c = F.when(is_printable(c), c).otherwise(F.array_join(F.transform(F.split(c, ""), _escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


#: The short escapes of JSON.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _escaped(x: Column) -> Column:
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = F.ascii(x)  # the code point of the first character
    high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(1023)
    out = F.when(is_printable(x), x)
    for k, v in _SHORT.items():
        out = out.when(x == k, F.lit(v))
    return out.when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))


def canonical_json(**fields: Column) -> Column:
    """A compact JSON object with sorted keys. Values are JSON already, see json_string."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(fields[name].cast("string"), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def unsigned_zero(col: str | Column) -> Column:
    """The number, with -0.0 as 0.0: a mean that is zero but for rounding has a sign by chance."""
    return _c(col) + F.lit(0.0)


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by vertical bars."""
    return F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256)


def hash_index(digest: Column, n: Column | int) -> Column:
    """The last eight hex digits of a digest, modulo n."""
    v = F.conv(F.substring(digest, 57, 8), 16, 10).cast("long")
    return F.pmod(v, F.lit(n) if isinstance(n, int) else n)


def bounded_rate_count(n: Column, rate: float) -> Column:
    """How many of n a rate takes: rounded half to even, at least 1, at most n."""
    return F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(rate)).cast("long")))


def min_max(col: str | Column, lo: Column, hi: Column) -> Column:
    """0..1 between the fitted bounds, clipped; 0 where the bounds coincide."""
    return F.when(hi - lo <= 1e-12, F.lit(0.0)).otherwise(F.least(F.greatest((_c(col) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))


def sigmoid(col: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(col)))


def risk_level(col: str | Column) -> Column:
    """Below 0.3333 LOW, below 0.6667 MEDIUM, else HIGH; outside 0..1 an error."""
    c = _c(col)
    return (
        F.when(c.isNull() | (c < 0) | (c > 1), F.raise_error(F.lit("risk score outside 0..1")))
        .when(c < 0.3333, "LOW")
        .when(c < 0.6667, "MEDIUM")
        .otherwise("HIGH")
    )


def relative_change_percent(base: Column, value: Column) -> Column:
    """100 (value - base) / |base|; null for a base of 0."""
    return F.try_divide(100.0 * (value - base), F.abs(base))


def relative_loss(base: Column, value: Column) -> Column:
    """The share of the base that is lost, 0 for a gain; for a base of 0 the loss is 0."""
    return F.when(F.abs(base) < 1e-15, F.lit(0.0)).otherwise(F.greatest((base - value) / base, F.lit(0.0)))


def set_jaccard(a: str | Column, b: str | Column) -> Column:
    """The Jaccard index of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def cyclic_next(value: Column, levels: Column, step: int = 1) -> Column:
    """The level ``step`` places after ``value`` in a sorted array, starting over at its end."""
    at = F.array_position(levels, value).cast("int")
    return F.when(at > 0, F.element_at(levels, F.pmod(at - 1 + step, F.size(levels)) + 1)).otherwise(value)
