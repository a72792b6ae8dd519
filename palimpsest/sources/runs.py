"""Sorted runs: range-partitioned, key-ordered Parquet; file statistics are the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import record_size

#: Every so many records a run's sparse index has an entry (the first always). Fixed by the format.
INTERVAL = 32


def write(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """One sorted run: files cover disjoint key ranges, rows within a file follow the key."""
    ranged = df.repartitionByRange(partitions, "key") if partitions else df.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def positions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a run with ``pos`` (from 0 in key order over all files) and ``offset`` (record bytes before it).

    Only per-file totals are ordered across files; a window never spans more than one file.
    """
    rows = read(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sized = rows.withColumn("_size", record_size(F.col("key"), F.col("value")))
    totals = sized.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"), F.min("key").alias("_low"))
    before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"))
    within = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    out = summed.join(starts, F.col("_file") == F.col("_f")).withColumn("pos", F.col("_n0") + F.col("_at")).withColumn("offset", F.col("_b0") + F.col("_before"))
    return out.select(*rows.columns[:-2], "pos", "offset")


def sparse_index(spark: SparkSession, path: str, schema, interval: int = INTERVAL) -> DataFrame:
    """(pos, key, offset) of every ``interval``-th record of a run, the first always."""
    return positions(spark, path, schema).filter(F.col("pos") % interval == 0).select("pos", "key", "offset")
