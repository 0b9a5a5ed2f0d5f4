"""Identifiers and checksums: SHA-256 of parts joined by a separator that no part has. Null parts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_space


def _joined(parts: tuple[Column, ...], separator: str) -> Column:
    return F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 32 hex digits."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(_joined((F.lit(prefix), *parts), "\0"), 256), 1, 32))


def content_hash(*parts: Column) -> Column:
    return F.sha2(_joined(parts, "\0"), 256)


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(_joined(parts, "\x1f"), 256), 1, 32)


def message_hash(turn: Column, role: Column, content: Column) -> Column:
    return F.sha2(_joined((turn, role, content), "\n"), 256)


def instant(c: Column) -> Column:
    """A time as text: UTC, fractions without trailing zeros; empty for null."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z")), F.lit(""))


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order; "null" for null."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.lit("null"))


def event_checksum() -> Column:
    """What makes an event the same: name space, context, session, actor, kind, reference, time, content and metadata."""
    return content_hash(normalize_space(F.col("space")), *(F.col(c) for c in ("context_id", "session_id", "actor", "source_kind", "source_ref")), instant(F.col("occurred_at")), F.col("content"), sorted_json(F.col("metadata")))
