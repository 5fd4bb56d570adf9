"""Text helpers: note previews, URI locality and redaction, secret snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE_PREVIEW_CHARS = 200

_FIRST_LINE = r"(?U)[^\s\x1c-\x1f][^\n\r\x0b\f\x1c-\x1e\x85  ]*"

# Patterns and their replacements, applied in this order.
ERROR_REDACTIONS = [
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+", "<redacted bearer>"),
    (r"(?i)api[_-]?key[=:]\s*[^,\s]+", "api_key=<redacted>"),
    (r"(?i)password[=:]\s*[^,\s]+", "password=<redacted>"),
    (r"(?i)secret[=:]\s*[^,\s]+", "secret=<redacted>"),
    (r"ghp_[A-Za-z0-9_]+", "ghp_<redacted>"),
    (r"AKIA[0-9A-Z]{16}", "AKIA<redacted>"),
]


def note_preview(body: Column) -> Column:
    """First non-blank line, trimmed; longer than 200 characters ends in an ellipsis."""
    line = F.regexp_replace(F.regexp_extract(body, _FIRST_LINE, 0), r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(F.length(line) > NOTE_PREVIEW_CHARS,
                  F.concat(F.substring(line, 1, NOTE_PREVIEW_CHARS - 1), F.lit("…"))).otherwise(line)


def uri_locality(uri: Column) -> Column:
    low = F.lower(uri)
    return (
        F.when(low.startswith("gs://"), "gcs").when(low.startswith("s3://"), "s3")
        .when(low.startswith("wandb:"), "wandb")
        .when(low.startswith("http://") | low.startswith("https://"), "http")
        .when(low.startswith("file://"), "local-fs")
        .when(F.contains(low, F.lit("://")), "other").otherwise("local-fs")
    )


def uri_basename(uri: Column) -> Column:
    """Last path segment; one trailing slash is ignored, an empty segment reads ``artifact``."""
    plain = F.when(F.lower(uri).startswith("file://"), F.substr(uri, F.lit(8))).otherwise(uri)
    slashed = F.translate(plain, "\\", "/")
    trimmed = F.regexp_replace(slashed, "/$", "")
    return F.coalesce(F.nullif(F.substring_index(trimmed, "/", -1), F.lit("")), F.lit("artifact"))


def display_uri(artifact_id: Column, uri: Column) -> Column:
    return F.when(uri_locality(uri) == "local-fs",
                  F.concat(F.lit("local:"), artifact_id, F.lit("/"), uri_basename(uri))).otherwise(uri)


def local_path(uri: Column, skip_wandb: bool = True) -> Column:
    """Path of a URI that names a local file, else NULL.

    Any ``scheme:`` other than ``file`` makes the URI non-local (so does a Windows
    drive letter, which parses as a scheme).  Percent escapes of file URIs are decoded.
    """
    file_path = F.try_url_decode(F.replace(
        F.regexp_replace(F.regexp_extract(uri, r"^[^:]+:(?://[^/?#]*)?([^?#]*)", 1), "/+$", "/"), F.lit("+"), F.lit("%2B")))
    # plain tests first: most URIs need no regular expression
    return (F.when(~F.contains(uri, F.lit(":")), uri).when(F.lower(F.substring_index(uri, ":", 1)) == "file", file_path)
            .when(~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), uri))


def secret_snippet(match: Column) -> Column:
    return F.when(F.length(match) <= 8, F.lit("<redacted>")).otherwise(
        F.concat(F.substring(match, 1, 4), F.lit("..."), F.right(match, F.lit(4))))


def sanitize_error(message: Column) -> Column:
    for pattern, replacement in ERROR_REDACTIONS:
        message = F.regexp_replace(message, pattern, replacement)
    return message


def glob_regex(pattern: str) -> str:
    """Case-sensitive shell glob as an anchored regular expression; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def matches_any(column: Column, globs: list[str]) -> Column:
    return column.rlike("|".join(glob_regex(g) for g in globs))
