"""Runs as single binary files: records in key order, a sparse index, a footer.

    records (see functions.codec), index entries (i32 key length, key, i64 offset of the record), and
    i64 offset of the index, i64 its size, i64 number of records; all big-endian

For exchange with stores that keep such files; the library's own runs are Parquet. Unlike the tail of a log, which may
be cut off by a crash, a run was complete when it appeared: damage is an error.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.cells import generation, record_size
from palimpsest.functions.codec import decode_bytes, encode
from palimpsest.operators.snapshot import newest_wins
from palimpsest.sources.runs import INTERVAL

FOOTER = 24
#: Record bytes of a file that this library makes.
FILE_BYTES = 64 << 20


def join(entries: Iterable[tuple[bytes, bytes]], interval: int = INTERVAL) -> bytes:
    """A file of (key, encoded record) in key order."""
    data, index, n = bytearray(), bytearray(), 0
    for key, record in entries:
        if n % interval == 0:
            index += struct.pack(">i", len(key)) + key + struct.pack(">q", len(data))
        data += record
        n += 1
    return bytes(data + index + struct.pack(">qqq", len(data), len(index), n))


def records(content: bytes) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """(position, key, value, expiry_ms) of a file; ValueError if it is damaged."""
    if len(content) < FOOTER:
        raise ValueError("a run is shorter than its footer")
    at, size, n = struct.unpack(">qqq", content[-FOOTER:])
    if at < 0 or size < 0 or at + size + FOOTER != len(content):
        raise ValueError("a run's footer does not fit its length")
    seen = 0
    for seen, r in enumerate(decode_bytes(content[:at]), 1):
        yield r
    if seen != n:
        raise ValueError(f"a run has {n} records but only {seen} can be read")


def index(content: bytes) -> list[tuple[bytes, int]]:
    """(key, offset) entries of a file's sparse index."""
    at, size, _ = struct.unpack(">qqq", content[-FOOTER:])
    out, end = [], at + size
    while at < end:
        (n,) = struct.unpack_from(">i", content, at)
        out.append((content[at + 4 : at + 4 + n], struct.unpack_from(">q", content, at + 4 + n)[0]))
        at += 12 + n
    return out


def find(content: bytes, key: bytes) -> tuple[bytes | None, int] | None:
    """(value, expiry_ms) of a key in a file, None if it is not there: the index gives where to begin, and at most an interval is decoded."""
    entries = index(content)
    at = bisect_right(entries, key, key=lambda e: e[0]) - 1
    if at < 0:
        return None
    end = entries[at + 1][1] if at + 1 < len(entries) else struct.unpack(">q", content[-FOOTER : 8 - FOOTER])[0]
    for _, k, value, expiry in decode_bytes(content[entries[at][1] : end]):
        if k == key:
            return value, expiry
    return None


def lookup(found: DataFrame, keys: Sequence[bytes]) -> DataFrame:
    """(key, generation, value, expiry_ms) of the newest version, tombstones too, of each of a few ``keys`` that some file (generation, content) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        for b in batches:
            for number, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(k, number, *hit) for k in keys if (hit := find(content, k))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "generation", "value", "expiry_ms"])

    hits = found.select("generation", "content").mapInArrow(run, "key binary, generation int, value binary, expiry_ms long")
    return newest_wins(hits, ["key"], "generation")


def files_for(run: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many files of about ``file_bytes`` hold the records of a run: a task builds one of them in memory."""
    total = run.agg(F.coalesce(F.sum(record_size(F.col("key"), F.col("value"))), F.lit(0))).first()[0]
    return max(1, -(-total // file_bytes))


def encoded(run: DataFrame, files: int) -> DataFrame:
    """(generation, content): ``run`` (key, value, expiry_ms) as ``files`` files that cover disjoint key ranges."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, entries = 0, []
        for b in batches:
            if b.num_rows:
                number = b.column(0)[0].as_py()
                entries += zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([join(entries)], pa.binary())], ["generation", "content"])

    ranged = run.repartitionByRange(files, "key").sortWithinPartitions("key")
    cells = ranged.select(F.spark_partition_id().alias("generation"), F.col("key").cast("binary").alias("key"), encode(F.col("key"), F.col("value"), F.col("expiry_ms")).alias("record"))
    return cells.mapInArrow(build, "generation int, content binary")


def decoded(found: DataFrame) -> DataFrame:
    """(generation, pos, key, value, expiry_ms) of files (generation, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        for b in batches:
            for number, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(number, *r) for r in records(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["generation", "pos", "key", "value", "expiry_ms"])

    return found.select("generation", "content").mapInArrow(run, "generation int, pos long, key binary, value binary, expiry_ms long")


def read(spark: SparkSession, directory: str, pattern: str = "sstable-*.sst", prefix: str = "sstable", suffix: str = "sst") -> DataFrame:
    """The records of the run files in a folder; larger generations are newer. Left-over temporary files do not match the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return decoded(files.select(generation(F.col("path"), prefix, suffix).alias("generation"), "content"))
