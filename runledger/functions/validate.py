"""Field checks as columns: NULL when fine, else the error text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.schemas import (ATTR_KEY_PATTERN, ATTR_PREFIX, IDEMPOTENCY_KEY_PATTERN, NOTE_BODY_MAX_BYTES, NOTE_TITLE_MAX_CHARS,
                               SHA256_PATTERN, UTC_Z_PATTERN)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def required(c: str, label: str | None = None) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing required field '{label or c}'"))


def choice(c: str | Column, allowed: list[str], label: str) -> Column:
    return F.when(~_c(c).isin(allowed), F.concat(F.lit(f"invalid {label} '"), _c(c), F.lit("'")))


def parse_utc_z(c: str | Column) -> Column:
    """Text timestamp ending in Z as TIMESTAMP_NTZ; NULL when malformed or not a real date."""
    text = _c(c)
    return F.when(text.rlike(UTC_Z_PATTERN), F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))


def utc_z(c: str) -> Column:
    return (F.when(F.col(c).isNotNull() & ~F.col(c).rlike(UTC_Z_PATTERN), F.lit(f"{c} must be a UTC timestamp ending in Z"))
            .when(F.col(c).isNotNull() & parse_utc_z(c).isNull(), F.lit(f"{c} is not a valid timestamp")))


def content_hash(c: str | Column) -> Column:
    return F.when(~_c(c).rlike(SHA256_PATTERN), F.lit("content hash must be sha256: and 64 hex digits"))


def idempotency_key(c: str | Column) -> Column:
    return F.when(~_c(c).rlike(IDEMPOTENCY_KEY_PATTERN), F.lit("malformed idempotency key"))


def attr_keys(c: str | Column) -> Column:
    """Keys must be lowercase dotted names outside the reserved namespace."""
    keys = F.json_object_keys(_c(c))
    return (F.when(F.exists(keys, lambda k: k.startswith(ATTR_PREFIX)), F.lit(f"{ATTR_PREFIX}* attributes are reserved"))
            .when(F.exists(keys, lambda k: ~k.rlike(ATTR_KEY_PATTERN)), F.lit("attribute keys must be lowercase dotted names")))


def tag(c: str | Column) -> Column:
    t = F.trim(F.lower(_c(c)))
    return F.when(t == "", F.lit("tag cannot be empty")).when(t.rlike(r"\s"), F.lit("tag cannot contain whitespace"))


def note_title(c: str | Column) -> Column:
    t = F.trim(_c(c))
    return F.when(t == "", F.lit("note title must not be empty")).when(
        F.length(t) > NOTE_TITLE_MAX_CHARS, F.lit(f"note title is longer than {NOTE_TITLE_MAX_CHARS} characters"))


def note_body(c: str | Column) -> Column:
    return F.when(_c(c) == "", F.lit("note body must not be empty")).when(
        F.octet_length(_c(c)) > NOTE_BODY_MAX_BYTES, F.lit(f"note body is larger than {NOTE_BODY_MAX_BYTES} bytes"))


def python_float(c: Column) -> Column:
    """Number the way the ledger reads it: decimal text, inf, infinity or nan in any case; NULL otherwise."""
    text = F.trim(c)
    low = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return (F.when(low.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(low == "nan", F.lit(float("nan")))
            .when(text.rlike(r"^[+-]?(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?$"), F.regexp_replace(text, "_", "").try_cast("double")))


def errors(*checks: Column) -> Column:
    """All error texts of a row as an array, empty when the row is fine."""
    return F.filter(F.array(*checks), lambda e: e.isNotNull())
