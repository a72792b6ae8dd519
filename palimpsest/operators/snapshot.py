"""Newest-wins state of a mutation log, and reads of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import entry_size, is_expired, is_live, is_tombstone


def newest_wins(log: DataFrame, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """The row with the largest ``order`` of each key.

    Catalyst keeps one row per key and map task before the shuffle, so a hot key costs no more than any other.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def newest_wins_by_max(log: DataFrame, order: str = "seq") -> DataFrame:
    """(key, seq, value, expiry_ms): the same by aggregation; for logs of which few columns are needed."""
    return log.groupBy("key").agg(F.max_by(F.struct(order, "value", "expiry_ms"), order).alias("r")).select("key", f"r.{order}", "r.value", "r.expiry_ms")


def live(newest: DataFrame, now_ms: Column | int) -> DataFrame:
    """Keys whose newest version is neither a tombstone nor expired. Never push this below the ranking."""
    return newest.filter(is_live(F.col("value"), F.col("expiry_ms"), _time(now_ms)))


def snapshot(log: DataFrame, now_ms: Column | int) -> DataFrame:
    return live(newest_wins(log), now_ms)


def as_of(log: DataFrame, seq: int, now_ms: Column | int) -> DataFrame:
    """The state after the mutation ``seq``: the filter reaches the scan."""
    return snapshot(log.filter(F.col("seq") <= seq), now_ms)


def tombstones(newest: DataFrame) -> DataFrame:
    return newest.filter(is_tombstone(F.col("value")))


def expired(newest: DataFrame, now_ms: Column | int) -> DataFrame:
    return newest.filter(F.col("value").isNotNull() & is_expired(F.col("expiry_ms"), _time(now_ms)))


def _time(now_ms: Column | int) -> Column:
    return now_ms if isinstance(now_ms, Column) else F.lit(now_ms)


def get(log: DataFrame, key, now_ms: Column | int) -> DataFrame:
    """(key, hit, value): one row for one key, whether it was ever written or not. The key's filter is pushed to the scan."""
    asked = log.sparkSession.range(1).select(F.lit(key).alias("_asked"))
    return multi_get(log.filter(F.col("key") == F.lit(key)), asked, now_ms)


def multi_get(log: DataFrame, asked: DataFrame, now_ms: Column | int) -> DataFrame:
    """(key, hit, value) for each row of ``asked`` (one column of keys)."""
    (name,) = asked.columns
    found = snapshot(log, now_ms).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    joined = asked.join(found, F.col(name) == F.col("_key"), "left")
    return joined.select(F.col(name).alias("key"), F.col("_key").isNotNull().alias("hit"), F.col("_value").alias("value"))


def scan(log: DataFrame, low, high, now_ms: Column | int) -> DataFrame:
    """Live keys in [low, high), in order (an extension: the store itself has no range verb)."""
    return snapshot(log.filter((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high))), now_ms).orderBy("key")


def footprint(log: DataFrame) -> DataFrame:
    """(n_keys, n_bytes) of a memtable that holds the log: distinct keys, tombstones too, and their counted bytes."""
    sizes = newest_wins(log).select(entry_size(F.col("key"), F.col("value")).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))
