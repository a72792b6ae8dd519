"""Best-fit-decreasing packing into id matrices.

Documents' ids are packed, longest first, into the row with the least free space that still fits; a
segment tree over free space finds it. Overlong documents are split losslessly: full rows and a rest that
is packed like any other. A window of documents is packed by the task that tokenises it, so nothing is
shuffled; a row of the result is a row of the matrix with its cumulative segment lengths and positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import document_ids

ROW_LENGTH, PAD_ID = 2048, 0
#: Ids that a task packs together.
WINDOW_IDS = 4_000_000


class FreeSpace:
    """Open rows by free space; a segment tree over free space counts them and finds the least that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, space: int, by: int) -> None:
        node = space + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, space: int) -> None:
        if space:
            self.rows[space].append(row)
            self._add(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its free space) with the least free space of at least ``need``; None if there is none."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._add(space, -1)
        return self.rows[space].pop(), space


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (each 1 to ``most``): best fit, longest first; ties in the given order."""
    rows: list[list[int]] = []
    free = FreeSpace(most)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := free.take(lengths[i]):
            row, space = found
            rows[row].append(i)
        else:
            row, space = len(rows), most
            rows.append([i])
        free.put(row, space - lengths[i])
    return rows


def segments(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length): full rows, then the rest."""
    return [(at, min(most, n - at)) for at in range(0, n, most)]


SCHEMA = "sequence_id long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


def packed(docs: DataFrame, row_length: int = ROW_LENGTH, tokenizer: str | None = None, window_ids: int = WINDOW_IDS) -> DataFrame:
    """One row for each packed sequence.

    ``ids``: ``row_length`` little-endian uint32, padded with ``PAD_ID``; ``cu_seqlens``: 0 and the end of each segment;
    ``positions``: int32, from 0 in each segment and in the padding; ``doc_ids`` and ``starts``: document of each
    segment and the ids before it there. ``sequence_id`` is unique and the same for the same layout of the input. A
    null text is an empty one: the end id alone. Null doc_ids stay null; repeated rows are packed again; segments that tie in length come in
    the order of the input; an empty table gives an empty result. Other columns, whatever their names, are not read. A text is
    tokenised whole; a task holds the ids of a window, or of one text if that is longer.
    """
    return _rows(docs, row_length, tokenizer, window_ids, _as_matrix, SCHEMA)


def digested(docs: DataFrame, row_length: int = ROW_LENGTH, tokenizer: str | None = None, window_ids: int = WINDOW_IDS) -> DataFrame:
    """The rows of ``packed`` as (sequence_id, n_segments, n_tokens, n_resets, ids_crc32, cu_seqlens, doc_ids, starts).

    The matrices are made and digested by the task that packs; ``n_resets`` counts the positions that are 0.
    """
    schema = "sequence_id long, n_segments long, n_tokens long, n_resets long, ids_crc32 long, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
    return _rows(docs, row_length, tokenizer, window_ids, _as_digest, schema)


def _rows(docs: DataFrame, row_length: int, tokenizer: str | None, window_ids: int, form, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        held: list[tuple] = []
        waiting = 0
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(document_ids(text, tokenizer), np.uint32)
                held += [(d, at, ids[at : at + n]) for at, n in segments(len(ids), row_length)]
                waiting += len(ids)
                if waiting >= window_ids:
                    for out in _matrices(held, row_length, number):
                        number += len(out[0])
                        yield form(*out)
                    held, waiting = [], 0
        for out in _matrices(held, row_length, number):
            number += len(out[0])
            yield form(*out)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, schema)


def _matrices(held: list[tuple], row_length: int, first: int, at_once: int = 512) -> Iterator[tuple]:
    """(sequence ids, id matrix, position matrix, cumulative lengths, doc_ids, starts) of up to ``at_once`` rows."""
    rows = best_fit([len(x[2]) for x in held], row_length)
    ramp = np.arange(row_length, dtype=np.int32)
    for at in range(0, len(rows), at_once):
        some = rows[at : at + at_once]
        ids = np.full((len(some), row_length), PAD_ID, np.uint32)
        positions = np.zeros((len(some), row_length), np.int32)
        ends: list[list[int]] = []
        for k, row in enumerate(some):
            end = [0]
            for i in row:
                n = len(held[i][2])
                ids[k, end[-1] : end[-1] + n] = held[i][2]
                positions[k, end[-1] : end[-1] + n] = ramp[:n]
                end.append(end[-1] + n)
            positions[k, end[-1] :] = ramp[: row_length - end[-1]]
            ends.append(end)
        yield list(range(first + at, first + at + len(some))), ids, positions, ends, [[held[i][0] for i in row] for row in some], [[held[i][1] for i in row] for row in some]


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], list(columns))


def _as_matrix(number, ids, positions, ends, docs, starts) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return _batch({
        "sequence_id": (number, pa.int64()), "ids": ([x.tobytes() for x in ids], pa.binary()), "cu_seqlens": (ends, pa.list_(pa.int32())),
        "positions": ([x.tobytes() for x in positions], pa.binary()), "doc_ids": (docs, longs), "starts": (starts, longs),
    })


def _as_digest(number, ids, positions, ends, docs, starts) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return _batch({
        "sequence_id": (number, pa.int64()), "n_segments": ([len(x) for x in docs], pa.int64()), "n_tokens": ([x[-1] for x in ends], pa.int64()),
        "n_resets": ((positions == 0).sum(axis=1), pa.int64()), "ids_crc32": ([zlib.crc32(x) for x in ids], pa.int64()), "cu_seqlens": (ends, pa.list_(pa.int32())), "doc_ids": (docs, longs), "starts": (starts, longs),
    })


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrix as Parquet: a file is a block of rows, ``ids`` and ``positions`` its fixed-width binary rows."""
    packed(docs, **options).write.parquet(path)
