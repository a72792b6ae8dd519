"""Which mutation closes which memtable.

The rule is sequential by nature: the size of the open memtable depends on where the last one closed. The
pass streams over the log in order and holds one memtable, which the threshold bounds; it reads keys and sizes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import entry_size

THRESHOLD = 4 << 20


def boundaries(log: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(flush, last_seq, n_keys, n_bytes) of each closed memtable; the open rest, if any, has flush NULL.

    A key counts key and value bytes; an overwrite counts the difference. A memtable closes with the mutation that brings it to the threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict = {}
        total, done, last = 0, 0, None
        names, kinds = ["flush", "last_seq", "n_keys", "n_bytes"], [pa.int64()] * 4
        for b in batches:
            out = []
            for seq, key, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total += size - sizes.get(key, 0)
                sizes[key], last = size, seq
                if total >= threshold:
                    out.append((done, seq, len(sizes), total))
                    sizes, total, done = {}, 0, done + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, last, len(sizes), total)], names)

    ordered = log.select("seq", "key", entry_size(F.col("key"), F.col("value")).alias("size")).repartition(1).sortWithinPartitions("seq")
    return ordered.mapInArrow(run, "flush long, last_seq long, n_keys long, n_bytes long")
