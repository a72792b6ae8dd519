"""Layers of runs: lookup newest first, merge, compaction, floor search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import is_expired, is_live
from palimpsest.operators.snapshot import newest_wins
from palimpsest.plans.shared import materialize

#: Rows that one ordered range should hold.
RANGE_ROWS = 200_000


def merge(runs: DataFrame, rank: str = "generation") -> DataFrame:
    """One row per key over all runs: that of the newest run (largest ``rank``)."""
    return newest_wins(runs, ["key"], rank)


def compact(runs: DataFrame, now_ms: Column | int, rank: str = "generation") -> DataFrame:
    """``merge`` without keys whose winner is a tombstone or expired; older versions do not come back.

    Only legal when all older runs take part.
    """
    return merge(runs, rank).filter(is_live(F.col("value"), F.col("expiry_ms"), now_ms if isinstance(now_ms, Column) else F.lit(now_ms)))


def compaction_stats(runs: DataFrame, now_ms: Column, rank: str = "generation") -> DataFrame:
    """(n_in, n_superseded, n_tombstones, n_expired, n_out) of compacting ``runs``: one pass over the winners and their group sizes."""
    total = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("value", "expiry_ms"), rank).alias("r"))
    dead, old = F.col("r.value").isNull(), is_expired(F.col("r.expiry_ms"), now_ms)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return total.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_in"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_superseded"),
        one(dead).alias("n_tombstones"), one(~dead & old).alias("n_expired"), one(~dead & ~old).alias("n_out"),
    )


def layered_lookup(layers: DataFrame, now_ms: Column, rank: str = "layer") -> DataFrame:
    """(key, layer, state, value): per key the newest layer that knows it; a tombstone or expired hit ends the search."""
    hit = newest_wins(layers, ["key"], rank)
    state = F.when(F.col("value").isNull(), "tombstone").when(is_expired(F.col("expiry_ms"), now_ms), "expired").otherwise("live")
    return hit.select("key", rank, state.alias("state"), F.when(state == "live", F.col("value")).alias("value"))


def floor_search(index: DataFrame, probes: DataFrame, rows: int) -> DataFrame:
    """(probe, floor_key, floor_offset): for each probe the greatest index key that is not beyond it; NULL below the first.

    Index (key, offset) and probes (probe) are sorted together by range; equal probes are told apart by a number, so that even
    one key that most probes ask for spreads over tasks. Each range takes over the last entry of those before it, which is a
    row for each range, and carries entries on in one ordered pass. ``rows``: about how many there are.
    """
    spark = index.sparkSession
    index = materialize(index.select("key", "offset"), "index")  # ranges are found by a pass of their own over both sides
    entries = index.select(F.col("key").alias("k"), F.lit(0).alias("kind"), F.struct(F.col("key").alias("key"), F.col("offset").alias("offset")).alias("entry"))
    asked = probes.select(F.col("probe").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
    both = entries.unionByName(asked).withColumn("tie", F.monotonically_increasing_id())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    dealt = materialize(both.repartitionByRange(ranges, "k", "kind", "tie").drop("tie").withColumn("range", F.spark_partition_id()), "ranges")
    lasts = dealt.groupBy("range").agg(F.max_by("entry", F.when(F.col("kind") == 0, F.col("k"))).alias("held"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(F.col("range").alias("r"), F.last_value("held", True).over(earlier).alias("carry"))
    upto = Window.partitionBy("range").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.last_value("entry", True).over(upto)).filter("kind = 1").join(carry, F.col("range") == F.col("r"))
    last = F.coalesce("own", "carry")
    return found.select(F.col("k").alias("probe"), last["key"].alias("floor_key"), last["offset"].alias("floor_offset"))
