"""Whole command logs: what each command saw, and its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import MAX_LINE, expiry_of, is_live, strip
from palimpsest.functions.commands import BAD_TTL, TOO_LONG, parse, respond
from palimpsest.plans.shared import materialize

#: Rows of ``seq`` in a block: a key's history is walked block by block, so no task holds all of a hot key.
BLOCK = 1_000_000


def with_previous(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """``log`` (seq, key, mutates, value, expiry_ms, ...) with ``prev``: STRUCT<value, expiry_ms> of the key's last mutation before the row, or NULL.

    Within a block of ``seq`` a window finds it; rows with none there take the last mutation of earlier
    blocks, of which there is one row per key and block.
    """
    cell = F.when(F.col("mutates"), F.struct("value", "expiry_ms"))
    blocked = log.withColumn("_block", F.floor(F.col("seq") / block))
    within = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = blocked.withColumn("_near", F.last_value(cell, True).over(within))
    held = blocked.groupBy("key", "_block").agg(F.max_by(F.struct("value", "expiry_ms"), F.when(F.col("mutates"), F.col("seq"))).alias("_last"))
    earlier = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.select("key", "_block", F.last_value("_last", True).over(earlier).alias("_carry")).filter("_carry is not null")
    joined = near.join(carry, ["key", "_block"], "left")
    return joined.withColumn("prev", F.coalesce("_near", "_carry")).select(*log.columns, "prev")


def deletes(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, key, existed) of the tombstones of a mutation log (with ``ts_ms``): whether the key was live just before, by the clock of the delete."""
    seen = with_previous(log.withColumn("mutates", F.lit(True)), block).filter("value is null")
    existed = F.coalesce(is_live(F.col("prev.value"), F.col("prev.expiry_ms"), F.col("ts_ms")), F.lit(False))
    return seen.select("seq", "key", existed.alias("existed"))


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (seq, ts_ms, line, ...) with verb, key, value, ttl_s, error; blank lines, which get no response, are left out.

    A time to live beyond 64 bits of milliseconds is an error here, not a wrapped number; so is a line of more than MAX_LINE bytes, or
    that the column ``too_long``, if there is one, says was so before its CR went.
    """
    over = F.octet_length("line") > MAX_LINE
    if "too_long" in lines.columns:
        over = over | F.coalesce(F.col("too_long"), F.lit(False))
    out = lines.filter((strip(F.col("line")) != "") | over).withColumn("_c", parse(F.col("line"))).select(*lines.columns, "_c.*")
    no_time = F.col("error").isNull() & (F.col("ttl_s") > 0) & expiry_of(F.col("ts_ms"), F.col("ttl_s")).isNull()
    return out.withColumn("error", F.when(over, F.lit(TOO_LONG)).when(no_time, F.lit(BAD_TTL)).otherwise(F.col("error")))


def until_quit(commands: DataFrame) -> DataFrame:
    """Commands of each ``conn`` up to and with its first QUIT."""
    first = commands.filter("verb = 'QUIT' and error is null").groupBy(F.col("conn").alias("_conn")).agg(F.min("seq").alias("_quit"))
    return commands.join(first, F.col("conn") == F.col("_conn"), "left").filter("_quit is null or seq <= _quit").drop("_conn", "_quit")


def evaluate(commands: DataFrame, block: int = BLOCK, before: DataFrame | None = None) -> DataFrame:
    """(seq, verb, key, response, hit) of parsed commands, all against one store that starts with ``before`` (key, value, expiry_ms; default: empty).

    A failed command changes nothing; a GET sees the last mutation of its key at its own time; ``hit`` is set for GET and DEL.
    """
    ok = F.col("error").isNull()
    cells = commands.select(
        "seq", "ts_ms", "verb", "error", F.col("key"), (ok & F.col("verb").isin("SET", "DEL")).alias("mutates"),
        F.when(F.col("verb") == "SET", F.col("value")).alias("value"), F.when(F.col("verb") == "SET", expiry_of(F.col("ts_ms"), F.col("ttl_s"))).otherwise(F.lit(0)).cast("long").alias("expiry_ms"),
    )
    if before is not None:  # as mutations before all others, at most one a key
        first = commands.agg(F.min("seq")).scalar() - 1
        blank = {"ts_ms": "long", "verb": "string", "error": "string"}
        held = before.select(first.alias("seq"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "key", F.lit(True).alias("mutates"), "value", "expiry_ms")
        cells = cells.unionByName(held)
    cells = materialize(cells, "cells")  # lines are parsed once, however often the plan reads them
    keyed, rest = cells.filter("key is not null"), cells.filter("key is null").withColumn("prev", F.lit(None).cast("struct<value: string, expiry_ms: bigint>"))
    seen = with_previous(keyed, block).unionByName(rest)
    alive: Column = F.coalesce(is_live(F.col("prev.value"), F.col("prev.expiry_ms"), F.col("ts_ms")), F.lit(False))
    response = respond(F.col("verb"), F.col("error"), F.when(alive, F.col("prev.value")), alive)
    return seen.filter("verb is not null").select("seq", "verb", "key", response.alias("response"), F.when(ok & F.col("verb").isin("GET", "DEL"), alive).alias("hit"))
