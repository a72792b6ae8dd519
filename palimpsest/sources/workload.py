"""A synthetic load: reads and writes of several workers over their own keys, deterministic by row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS_PER_WORKER = 1000


def generate(spark: SparkSession, workers: int = 8, ops: int = 5000, write_percent: int = 50, seed: int = 0) -> DataFrame:
    """(seq, worker, line): keys bench-<worker>-<0..999>; about ``write_percent`` of 100 lines are SET, the rest GET."""
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    rows = spark.range(workers * ops).withColumn("worker", F.col("id") % workers)
    key = F.concat(F.lit("bench-"), F.col("worker").cast("string"), F.lit("-"), draw("key", KEYS_PER_WORKER).cast("string"))
    line = F.when(draw("kind", 100) < write_percent, F.concat(F.lit("SET "), key, F.lit(" value-"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("GET "), key))
    return rows.select(F.col("id").alias("seq"), "worker", line.alias("line"))
