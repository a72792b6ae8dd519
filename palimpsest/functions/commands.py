"""The command language: one line, five verbs, one tagged response line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.cells import MAX_LINE, strip

#: A value with a time to live: text, one space, EX, spaces, digits to the end. Fixed by the language.
WITH_TTL = r"\A(.*)\sEX\s+(\d+)\z"
EMPTY, ARITY, BAD_TTL, UNKNOWN = "empty command", "wrong number of arguments for '", "invalid EX value", "unknown command '"
TOO_LONG = f"line exceeds maximum length of {MAX_LINE} bytes"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it (plain columns would be copied into every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(line: Column) -> Column:
    """STRUCT<verb, key, value, ttl_s, error>; a line that is no command has only verb and error.

    The verb ends at the first space (a tab parts nothing) and is upper-cased. A SET value runs to the end of
    the line, inner spaces kept, but for a trailing time to live.
    """
    return _let(strip(line), lambda text: _let(_verb_and_rest(text), lambda c: _let(_value_part(c), lambda v: _command(text, c, v))))


def _verb_and_rest(text: Column) -> Column:
    space = F.instr(text, " ")
    return F.when(space == 0, F.struct(F.upper(text).alias("verb"), F.lit("").alias("rest"))).otherwise(
        F.struct(F.upper(F.substring(text, F.lit(1), space - 1)).alias("verb"), strip(F.substring(text, space + 1, F.length(text))).alias("rest"))
    )


def _value_part(c: Column) -> Column:
    """Of what follows the verb: key, tail after the first space, and the tail's text and digits if it ends in a time to live."""
    rest = c["rest"]
    gap = F.instr(rest, " ")
    tail = F.when(gap > 0, F.substring(rest, gap + 1, F.length(rest)))
    return _let(tail, lambda t: F.struct(gap.alias("gap"), F.substring(rest, F.lit(1), gap - 1).alias("key"), t.alias("tail"), F.regexp_like(t, F.lit(WITH_TTL)).alias("timed"), F.regexp_extract(t, WITH_TTL, 1).alias("text"), F.regexp_extract(t, WITH_TTL, 2).try_cast("long").alias("ttl")))


def _command(text: Column, c: Column, v: Column) -> Column:
    verb, rest = c["verb"], c["rest"]
    value = F.when(v["timed"], v["text"]).otherwise(v["tail"])
    wrong = F.concat(F.lit(ARITY), verb, F.lit("'"))
    error = (
        F.when(text == "", F.lit(EMPTY))
        .when(verb.isin("PING", "QUIT"), F.lit(None))
        .when(verb.isin("GET", "DEL"), F.when((rest == "") | (v["gap"] > 0), wrong))
        .when(verb == "SET", F.when((v["gap"] == 0) | (value == ""), wrong).when(v["timed"] & v["ttl"].isNull(), F.lit(BAD_TTL)))
        .otherwise(F.concat(F.lit(UNKNOWN), verb, F.lit("'")))
    )
    sets = error.isNull() & (verb == "SET")
    return F.struct(
        verb.alias("verb"),
        F.when(sets, v["key"]).when(error.isNull() & verb.isin("GET", "DEL"), rest).alias("key"),
        F.when(sets, value).alias("value"),
        F.when(sets, F.when(v["timed"], v["ttl"]).otherwise(F.lit(0).cast("long"))).alias("ttl_s"),
        error.alias("error"),
    )


def status(text: str) -> Column:
    return F.lit(f"+{text}")


def bulk(value: Column) -> Column:
    """A value, or the sign of a miss; a stored "-1" looks the same on the wire, so results carry a hit flag too."""
    return F.concat(F.lit("$"), F.coalesce(value, F.lit("-1")))


def integer(number: Column) -> Column:
    return F.concat(F.lit(":"), number.cast("string"))


def failure(message: Column) -> Column:
    return F.concat(F.lit("-ERR "), message)


def respond(verb: Column, error: Column, found: Column, existed: Column) -> Column:
    """The response line without its line end. ``found``: live value that a GET sees; ``existed``: whether a DEL hit a live key."""
    return (
        F.when(error.isNotNull(), failure(error))
        .when(verb == "PING", status("PONG"))
        .when(verb.isin("SET", "QUIT"), status("OK"))
        .when(verb == "GET", bulk(found))
        .when(verb == "DEL", integer(F.when(existed, 1).otherwise(0)))
    )
