"""Helpers that the training-data operators share: gapless numbering, rows by text, tidy Python tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.shared import discard, materialize, shared_dir

__all__ = ["bodies", "dense_ids", "discard", "fresh", "kept_rows", "materialize", "partitions_for", "shared_dir", "text_bytes", "text_key", "tidy"]

#: Rows of one numbering block in :func:`dense_ids`; a block is sorted by one task.
BLOCK_ROWS = 50_000
#: Texts that a Python task holds as objects at once.
TEXTS_AT_ONCE = 512


def text_bytes(df: DataFrame, *others: str, text: str = "text") -> DataFrame:
    """Only the columns that an operator needs; the text as UTF-8 bytes."""
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("binary").alias("body"))


def text_key() -> Column:
    """SHA-256 of the whole text as it stands (null: of an empty one), 32 bytes: which row of a doc_id is meant."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or that with as many underscores before it as no column in ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def bodies(column: pa.Array) -> Iterator[bytes]:
    """The texts of a batch, a few at a time as Python objects; null: empty."""
    for at in range(0, len(column), TEXTS_AT_ONCE):
        for x in column.slice(at, TEXTS_AT_ONCE).to_pylist():
            yield x or b""


def tidy() -> None:
    """Give back what an earlier task left in this reused Python worker: token caches, pages that allocators keep."""
    if tokens := sys.modules.get("palimpsest.llm.tokens"):
        tokens.forget()
    pa.default_memory_pool().release_unused()
    if trim := sys.platform == "linux" and getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library that most systems have
        trim(0)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions so that none expects more than ``per_partition`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def dense_ids(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows: int, groups: int = 1) -> DataFrame:
    """Number the rows of each group from 0 without gaps, by blocks, so that no task sorts a whole group.

    ``df`` should be a written table: it is read twice. A block is a hash class of the ``order`` columns;
    blocks follow each other, rows within a block follow ``order``. Rows that tie on ``order`` get
    different numbers in any order. ``rows`` and ``groups`` only set the number of blocks.
    """
    blocks = max(8, -(-rows // (BLOCK_ROWS * max(groups, 1))))
    keyed = df.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit("block")), F.lit(blocks)).cast("int"))
    keys = [*group, "_block"]
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(keys)], "_start")
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    on = [ranked[c].eqNullSafe(starts[f"_s{i}"]) for i, c in enumerate(keys)]
    return ranked.join(starts, on).withColumn(name, F.col("_start") + F.col("_rank")).select(*df.columns, name)


def kept_rows(docs: DataFrame, drops: DataFrame, ties: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those in ``drops``, and one row for each pair in ``ties``, with all their columns.

    Both name rows by (id long, key binary): doc_id, null too, and :func:`text_key`. The rows are exchanged by (doc_id, key), of
    which only repeated rows share one, at every size alike, and meet a hash table of their partition's drops: texts are not sorted. Of
    rows that share a pair in ``ties`` (the usual case: none) the one with the least hash of all columns stays.
    """
    key, i, k, rank = (fresh(c, docs.columns) for c in ("row_key", "drop_id", "drop_key", "row_rank"))
    keyed = docs.withColumn(key, text_key())
    match = F.col(key).eqNullSafe(F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    named = lambda rows: rows.select(F.col("id").alias(i), F.col("key").alias(k)).hint("shuffle_hash")
    if ties.isEmpty():
        return keyed.join(named(drops), match, "left_anti").drop(key)
    out = keyed.join(named(drops.unionByName(ties)), match, "left_anti").drop(key)
    one = Window.partitionBy(key, "doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rest = keyed.join(named(ties), match, "left_semi").withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1)
    return out.unionByName(rest.drop(key, rank))
