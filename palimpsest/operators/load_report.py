"""Load-test reports: throughput and nearest-rank latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import ms_of


def latency(samples: DataFrame, column: str = "ns", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, p50, p95, p99, max): nearest rank, so each is a sample; neither interpolated nor approximate.

    Counts per distinct value are summed before the ranks are taken.
    """
    return samples.groupBy(*by).agg(F.count(F.col(column)).alias("n"), *_ranks(column))


def _ranks(column: str) -> list[Column]:
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")
    return [at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(column).alias("max")]


def throughput(samples: DataFrame, elapsed_s: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, elapsed_s, per_s). ``elapsed_s``: an aggregate, such as the time from the first to the last operation."""
    out = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), elapsed_s.alias("elapsed_s"))
    return out.withColumn("per_s", F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s")))


def report(samples: DataFrame, elapsed_s: Column, column: str = "ns", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, elapsed_s, per_s, p50_ms, p95_ms, p99_ms, max_ms): throughput and latencies, taken in nanoseconds, in one row."""
    out = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), elapsed_s.alias("elapsed_s"), *_ranks(column))
    per_s = F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s"))
    return out.select(*by, "n", "elapsed_s", per_s.alias("per_s"), *[ms_of(F.col(c)).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "max")])
