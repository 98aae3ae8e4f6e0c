"""Hashes, name-based identifiers and legal days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspan.functions.columns import as_col

# RFC 4122 name space for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def sha256(text) -> Column:
    return F.sha2(as_col(text), 256)


def uuid5(name) -> Column:
    """RFC 4122 version 5 identifier in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(as_col(name), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def stable_id(*parts, prefix: str = "lexspan") -> Column:
    """Identifier of colon-joined parts. Callers that must reproduce identifiers made
    elsewhere pass that system's prefix."""
    return uuid5(F.concat_ws(":", F.lit(prefix), *[as_col(p).cast("string") for p in parts]))


def point_id(article_id, document_version_id, child_id, prefix: str = "lexspan") -> Column:
    return stable_id(F.lit("point"), article_id, document_version_id, child_id, prefix=prefix)


def ordinal_day(day) -> Column:
    """Proleptic Gregorian ordinal: 0001-01-01 is day 1."""
    return F.date_diff(as_col(day).cast("date"), F.lit("0001-01-01").cast("date")) + 1


def iso_ordinal(text) -> Column:
    """Ordinal of an ISO date text, NULL for any other text."""
    col = as_col(text)
    return ordinal_day(F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).cast("date")))


# Control characters without a short escape whose number has a letter in it.
_LETTERED = [k for k in range(0x20) if k % 16 > 9 and k not in (0x0A, 0x0C, 0x0D)]


def _quoted(text: Column) -> Column:
    """A JSON string; control characters as Python's encoder writes them, in lower case."""
    plain = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]\z", 1)
    lowered = plain
    for code in _LETTERED:
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(text.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), lowered).otherwise(plain)


def json_string(text) -> Column:
    """A JSON string or null with the separators Python's encoder uses."""
    col = as_col(text)
    return F.when(col.isNull(), F.lit("null")).otherwise(_quoted(col))


def json_list(items) -> Column:
    """A JSON list of texts, ``", "`` between items."""
    parts = F.transform(as_col(items), _quoted)
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
