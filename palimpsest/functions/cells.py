"""Expressions over one cell: visibility, sizes, times, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: Largest key or value that a log record may hold, and longest command line, in bytes.
MAX_FIELD, MAX_LINE = 64 << 20, 1 << 20


def is_tombstone(value: Column) -> Column:
    return value.isNull()


def is_expired(expiry_ms: Column, now_ms: Column | int) -> Column:
    """0 never expires; the boundary is inclusive, and a negative expiry is in the past."""
    return (expiry_ms != 0) & (expiry_ms <= now_ms)


def is_live(value: Column, expiry_ms: Column, now_ms: Column | int) -> Column:
    """Only right for the newest version of a key: rank first, filter second."""
    return value.isNotNull() & ~is_expired(expiry_ms, now_ms)


def entry_size(key: Column, value: Column) -> Column:
    """Bytes that a memtable counts for an entry; a tombstone's value counts 0, the expiry nothing."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def record_size(key: Column, value: Column) -> Column:
    """Bytes of an encoded log record: four lengths and numbers of 20 bytes in all, the key, the value."""
    return entry_size(key, value) + 20


def expiry_of(ts_ms: Column, ttl_s: Column) -> Column:
    """Absolute expiry of a time to live; none (0 or less) never expires. NULL where it exceeds 64 bits."""
    return F.when(ttl_s > 0, F.try_add(ts_ms, F.try_multiply(ttl_s, F.lit(1000).cast("long")))).otherwise(F.lit(0).cast("long"))


def generation(path: Column, prefix: str = "wal", suffix: str = "log") -> Column:
    """The number in a segment's or run's file name; NULL for other names. Never order by the name: 10 sorts before 9."""
    found = F.regexp_extract(path, rf"(?:^|/){prefix}-(\d+)\.{suffix}$", 1)
    return found.try_cast("int")


def strip(text: Column) -> Column:
    """Without white space at either end (spaces, tabs, line ends and the other Unicode spaces but no-break ones)."""
    return F.regexp_replace(text, r"\A\p{javaWhitespace}+|\p{javaWhitespace}+\z", "")


def utf8(data: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def ms_of(ns: Column) -> Column:
    return ns / F.lit(1e6)
