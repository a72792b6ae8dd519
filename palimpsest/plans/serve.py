"""Command lines against a durable store: a batch at a time, or one by one."""

from __future__ import annotations

import io
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import cells
from palimpsest.functions.cells import MAX_LINE
from palimpsest.operators import commands, snapshot
from palimpsest.plans.shared import materialize
from palimpsest.plans.store import Store
from palimpsest.sources import lines


def execute(store: Store, batch: DataFrame, block: int = commands.BLOCK) -> DataFrame:
    """Run a batch of command lines (seq, ts_ms, conn, line) in order of seq; (seq, verb, key, response, hit) of each.

    Commands see the store as it was before the batch and each other's effects, each at its own time; their
    mutations are appended as one batch. ``seq`` orders the batch and need not continue the store's. A connection ends with its QUIT.
    If another writer commits meanwhile, Conflict is raised and nothing is appended.
    """
    now = store.manifest()
    batch = materialize(commands.until_quit(commands.parsed(batch)), "commands")
    known = snapshot.newest_wins(store.log(now)).select(cells.utf8(F.col("key")).alias("key"), cells.utf8(F.col("value")).alias("value"), "expiry_ms")
    before = known.join(batch.select("key").filter("key is not null").distinct(), "key", "left_semi")
    answers = materialize(commands.evaluate(batch, block, before), "answers")
    start, low = now.next_seq, batch.agg(F.min("seq")).first()[0]
    changes = batch.filter("error is null and verb in ('SET', 'DEL')")
    expiry = F.when(F.col("verb") == "SET", cells.expiry_of(F.col("ts_ms"), F.col("ttl_s"))).otherwise(F.lit(0))
    store.append(changes.select((F.col("seq") - F.lit(low or 0) + F.lit(start)).alias("seq"), F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), expiry.cast("long").alias("expiry_ms")), at=now)
    return answers


def execute_files(store: Store, path: str) -> DataFrame:
    """Run the command lines of text files, each a connection, in order of their paths: ``execute`` on ``sources.lines.numbered``."""
    return execute(store, lines.numbered(lines.read(store.spark, path), store.clock()))


def repl(store: Store, source: Iterable[str], out: TextIO) -> None:
    """Answer lines one by one until QUIT or their end; each line is a batch of its own."""
    for line in source:
        text = line.rstrip("\n")
        too_long = len(text.encode("utf-8", "surrogatepass")) > MAX_LINE
        df = store.spark.createDataFrame([(0, store.clock(), 0, text.removesuffix("\r"), too_long)], "seq long, ts_ms long, conn long, line string, too_long boolean")
        for row in execute(store, df).collect():
            out.write(row.response + "\r\n")
            out.flush()
            if row.verb == "QUIT" and row.response == "+OK":
                return


def answers(store: Store, text: str) -> str:
    """The responses to a text of lines, which only LF ends, as one session would get them."""
    out = io.StringIO()
    repl(store, io.StringIO(text, newline="\n"), out)
    return out.getvalue()
