"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, the longest first: as many of
the longest as fit, then the binary digits of the rest. Pieces of one length form a bucket, a piece is a sequence of its
own, and so no sequence crosses documents and none has padding. Sequences are numbered bucket by bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialize
from palimpsest.llm.tokens import document_ids

MAX_LENGTH = 2048
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place")


def pieces(n: int, longest: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, lengths falling powers of two up to ``longest``."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    width = longest
    while width := width >> 1:
        if n - at >= width:
            out.append((at, width))
            at += width
    return out


def cut(docs: DataFrame, longest: int = MAX_LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, place[, ids]): the pieces of every row, with their ids if asked for.

    ``place`` numbers a task's pieces of one length. A null text is an empty one: the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        places: dict[int, int] = {}
        for b in batches:
            rows: list[tuple] = []
            held: list[bytes] = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = document_ids(text, tokenizer)
                n = len(ids) // 4
                for at, width in pieces(n, longest):
                    piece = ids[4 * at : 4 * (at + width)]
                    place = places[width] = places.get(width, -1) + 1
                    rows.append((d, at, width, zlib.crc32(piece), n, task, place))
                    if with_ids:
                        held.append(piece)
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COLUMNS))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(held, pa.binary())] if with_ids else []), [*COLUMNS, *(["ids"] if with_ids else [])])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS) + (", ids binary" if with_ids else ""))


def packed(docs: DataFrame, longest: int = MAX_LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row for each piece of each row.

    A sequence holds one piece, at offset 0. Sequence ids have no gaps; the longest bucket comes first, within a
    bucket the tasks that cut the pieces follow each other: only their counts are summed, no piece is
    moved. Repeated rows give repeated pieces in sequences of their own, in any order; null doc_ids are kept; a null text is an empty one;
    an empty table gives an empty result. ``ids`` are little-endian unsigned 32-bit. Other columns, whatever their names, are not
    read. A text is tokenised whole, and a task holds its ids, four bytes each.
    """
    found = materialize(cut(docs, longest, tokenizer, with_ids), "pieces")
    per = found.groupBy("length", "task").count()
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length and task
    first = materialize(per.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "buckets")
    out = found.join(first, ["length", "task"]).withColumn("sequence_id", F.col("first") + F.col("place"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
