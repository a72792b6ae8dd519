"""Log segments: discovery, decoding, prefix-valid replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.cells import generation
from palimpsest.functions.codec import decode, encode

EMPTY = "segment int, content binary"


def segment_bytes(log: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, content): the records of each segment in commit order, encoded and joined. A segment is bounded by its writer."""
    record = F.struct("seq", encode(F.col("key"), F.col("value"), F.col("expiry_ms")).alias("data"))
    one = log.groupBy(F.col(segment).cast("int").alias("segment")).agg(F.array_sort(F.collect_list(record)).alias("r"))
    return one.select("segment", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["data"])), "")).alias("content"))


def segments(spark: SparkSession, directory: str) -> DataFrame:
    """(segment, content) of the files wal-<n>.log in a folder; none, or no folder: no rows."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(directory)
        found = files.select(generation(F.col("path")).alias("segment"), "content").filter("segment is not null")
        found.schema  # noqa: B018  resolves the path
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], EMPTY)
        raise
    return found


def replay(found: DataFrame) -> DataFrame:
    """(segment, pos, key, value, expiry_ms, seq): the valid prefix of each segment; a bad tail ends its own segment only.

    ``seq`` orders by segment, then position (2^31 records a segment at most).
    """
    return decode(found).withColumn("seq", F.shiftleft(F.col("segment").cast("long"), 31) + F.col("pos"))


def valid_prefix(log: DataFrame, segment: str, pos: str, ok: str) -> DataFrame:
    """Rows of each segment before its first row that is not ``ok``. One row per segment with a fault is joined, not a window over all."""
    bad = log.filter(~F.col(ok)).groupBy(F.col(segment).alias("_s")).agg(F.min(pos).alias("_bad"))
    return log.join(bad, F.col(segment) == F.col("_s"), "left").filter(F.col("_bad").isNull() | (F.col(pos) < F.col("_bad"))).drop("_s", "_bad")
