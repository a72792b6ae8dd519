"""The binary log record, big-endian: i32 key length, key, i64 expiry, i32 value length (-1: tombstone), value, i32 CRC-32 of all before.

Encoding is a column expression. Decoding walks bytes and ends at the first record that is cut off, has a
length out of bounds or a wrong checksum: the prefix before it is valid.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import MAX_FIELD


def _big_endian(number: Column, digits: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(number.cast("long")), 16, "0"), 17 - digits, digits))


def _bounded(data: Column, name: str) -> Column:
    return F.when(F.octet_length(data) > MAX_FIELD, F.raise_error(F.lit(f"a {name} is longer than {MAX_FIELD} bytes")).cast("binary")).otherwise(data)


def body(key: Column, value: Column, expiry_ms: Column) -> Column:
    """All of a record but its checksum. A key or value that a reader would take for damage is an error."""
    key, value = _bounded(key.cast("binary"), "key"), _bounded(value.cast("binary"), "value")
    length = F.coalesce(F.octet_length(value), F.lit(-1))
    return F.concat(_big_endian(F.octet_length(key), 8), key, _big_endian(expiry_ms, 16), _big_endian(length, 8), F.coalesce(value, F.lit(b"")))


def signed_crc32(data: Column) -> Column:
    """CRC-32 as a signed 32-bit number."""
    c = F.crc32(data)
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int")


def encode(key: Column, value: Column, expiry_ms: Column) -> Column:
    front = body(key, value, expiry_ms)
    return F.concat(front, _big_endian(F.crc32(front), 8))


def decode_bytes(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """(position, key, value, expiry_ms) of the valid prefix of a segment."""
    at, position = 0, 0
    while len(data) - at >= 4:
        (n,) = struct.unpack_from(">i", data, at)
        if not 0 <= n <= MAX_FIELD or len(data) - at < 20 + n:
            return
        expiry, m = struct.unpack_from(">qi", data, at + 4 + n)
        end = at + 16 + n + max(m, 0)
        if not -1 <= m <= MAX_FIELD or len(data) < end + 4 or zlib.crc32(data[at:end]) != int.from_bytes(data[end : end + 4], "big"):
            return
        yield position, data[at + 4 : at + 4 + n], None if m < 0 else data[at + 16 + n : end], expiry
        at, position = end + 4, position + 1


def decode(segments: DataFrame) -> DataFrame:
    """(segment, pos, key, value, expiry_ms) of segments (segment int, content binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        for b in batches:
            for segment, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(segment, *r) for r in decode_bytes(content or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["segment", "pos", "key", "value", "expiry_ms"])

    return segments.select("segment", "content").mapInArrow(run, "segment int, pos long, key binary, value binary, expiry_ms long")
