"""The event table as a mutation log, as a command log, and as sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import HOUR_MS
from palimpsest.operators.snapshot import newest_wins

#: Mutations of one log segment, and of one flushed run.
SEGMENT = 250


def _ts_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _hours(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def _key(user: Column) -> Column:
    return F.concat(F.lit("user:"), user.cast("string"))


def mutations(events: DataFrame) -> DataFrame:
    """(seq, key, value, expiry_ms, ts_ms): an error deletes its user's key, all else sets it; k hours to live, 0: for ever."""
    deletes = F.col("event_type") == "error"
    ts, hours = _ts_ms(F.col("ts")), _hours(F.col("props"))
    return events.select(
        F.col("event_id").alias("seq"), _key(F.col("user_id")).alias("key"), F.when(~deletes, F.col("value").cast("string")).alias("value"),
        F.when(deletes | (hours == 0), F.lit(0).cast("long")).otherwise(ts + hours * HOUR_MS).alias("expiry_ms"), ts.alias("ts_ms"),
    )


def command_log(events: DataFrame) -> DataFrame:
    """(seq, ts_ms, conn, line): signup and purchase SET (a purchase with a time to live), error DEL, all else GET; every 97th a PING."""
    key = _key(F.col("user_id"))
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    line = (
        F.when(F.col("event_id") % 97 == 0, F.lit("PING"))
        .when(kind == "signup", F.concat_ws(" ", F.lit("SET"), key, value))
        .when(kind == "purchase", F.concat_ws(" ", F.lit("SET"), key, value, F.lit("EX"), (_hours(F.col("props")) * 3600).cast("string")))
        .when(kind == "error", F.concat_ws(" ", F.lit("DEL"), key))
        .otherwise(F.concat_ws(" ", F.lit("GET"), key))
    )
    return events.select(F.col("event_id").alias("seq"), _ts_ms(F.col("ts")).alias("ts_ms"), (F.col("user_id") % 8).alias("conn"), line.alias("line"))


def generations(log: DataFrame) -> DataFrame:
    """The log with ``generation``: the run that each mutation is flushed to."""
    return log.withColumn("generation", F.floor(F.col("seq") / SEGMENT).cast("int"))


def runs(log: DataFrame) -> DataFrame:
    """Newest version of each key in each generation; tombstones and expired versions stay."""
    return newest_wins(generations(log), ["generation", "key"])
