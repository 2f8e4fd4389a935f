"""Identifiers: content hashes, name-based UUIDs, unsigned 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(pid: Column, ts_ms: Column, seq: Column, raw: Column) -> Column:
    """First 16 hex digits of SHA-256 over pid, time and sequence number, or the payload's hash where there is none."""
    tail = F.coalesce(seq.cast("string"), F.xxhash64(raw).cast("string"))
    return F.substr(F.sha2(F.concat_ws(":", pid, ts_ms.cast("string"), tail), 256), F.lit(1), F.lit(16))


def content_id(*cols: Column) -> Column:
    """64-bit content hash of columns."""
    return F.xxhash64(*cols)


def uuid3(text: Column) -> Column:
    """Name-based UUID (version 3) of a text's SHA-256."""
    h = F.md5(F.unhex(F.sha2(text, 256)))
    nibble = F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int")
    variant = F.lower(F.conv((nibble % 4 + 8).cast("string"), 10, 16))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def to_u64(text: Column) -> Column:
    """Unsigned 64-bit number, as decimal(20,0): 16 hex digits, else decimal digits, else hex digits, else the first 16 hex digits of the MD5."""
    hexed = lambda c: F.conv(c, 16, 10).cast("decimal(20,0)")
    return (
        F.when(text.rlike("^[0-9a-fA-F]{16}$"), hexed(text))
        .when(text.rlike("^[0-9]{1,19}$"), text.try_cast("decimal(20,0)"))
        .when(text.rlike("^[0-9a-fA-F]{1,16}$"), hexed(text))
        .otherwise(hexed(F.substr(F.md5(text), F.lit(1), F.lit(16))))
    )
