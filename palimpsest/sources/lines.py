"""Command lines from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import MAX_LINE
from palimpsest.plans.shared import materialize


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, too_long): LF ends a line, one CR before it goes, the last line may lack its LF.

    A line beyond the limit stays, flagged, so that it can be answered with an error. ``block``: where in the file the task began to read.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    return raw.select("file", "block", F.regexp_replace("value", "\r\\z", "").alias("line"), (F.octet_length("value") > MAX_LINE).alias("too_long"))


def numbered(found: DataFrame, ts_ms: int) -> DataFrame:
    """(seq, ts_ms, conn, line, too_long) of ``read``'s lines: seq counts from 0 over files by path and lines by place; a file is a connection.

    Lines of a block come in order, so their own ids count them; only blocks, a row for each, are ordered across files.
    """
    rows = materialize(found.withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = rows.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("f", "b")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("f", "b", "low", before.alias("start"), (F.dense_rank().over(Window.orderBy("f")) - 1).cast("long").alias("conn"))
    placed = rows.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.select((F.col("start") + F.col("at") - F.col("low")).alias("seq"), F.lit(ts_ms).cast("long").alias("ts_ms"), "conn", "line", "too_long")
