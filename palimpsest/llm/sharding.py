"""Sharding by Karmarkar-Karp differencing.

Indivisible groups (equal texts) go to shards so that bytes are near equal. A partial partition is a
row of shard sums; the two with the largest spread are combined, one in falling and one in rising
order, until one is left. Large groups (few, by their size) are differenced together by one task.
The rest follows in bands of falling size. A band is dealt into classes of bounded size, each
differenced by its own task together with a partial partition that stands for the class's part of the
imbalance left so far. Then the classes' partial partitions, a row of shard sums each, are matched with
one another: the widest first, its largest slot to the shard that lacks most. The next band levels what
the band before could not.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import dense_ids, materialize, text_key

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A group is large if it holds more than 1 / (shards x this) of all bytes: at most shards x this groups.
LARGE = 500
#: Mean groups of a class: what one task differences at once.
CLASS_GROUPS = 2_000
#: Sizes within a band differ by this factor; the last band has all below 1 / FINE of a class's even share.
BAND, FINE = 10, 4
#: Classes whose partial partitions one task matches; the driver gets one row for each such unit.
UNIT_CLASSES = 2_000


def difference(sizes: np.ndarray, shards: int, first: np.ndarray | None = None) -> np.ndarray:
    """The shard of each size, by repeated differencing into ``shards`` parts.

    ``first``: sums that the shards hold already, in shard order; it takes part as one more partial
    partition, and the shards keep their identity by it. Ties: the partial partition that came first.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int32)
    down = np.arange(shards)
    sums: dict[int, np.ndarray] = {}
    slots: dict[int, np.ndarray] = {}  # of combined nodes: old slot of the left child for each new slot
    kids: dict[int, tuple[int, int]] = {}
    heap: list[tuple[int, int]] = []
    for i in range(n):
        heap.append((-int(sizes[i]), i))
    lead = None
    if first is not None:
        lead, order = n, np.argsort(-first, kind="stable")
        sums[n] = first[order] - first.min()
        heap.append((-int(sums[n][0]), n))
    heapq.heapify(heap)
    made = n + 1
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        left = sums.pop(a) if a in sums else _leaf(int(sizes[a]), shards)
        right = sums.pop(b) if b in sums else _leaf(int(sizes[b]), shards)
        both = left + right[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[made], slots[made], kids[made] = both, order.astype(np.int32), (a, b)
        heapq.heappush(heap, (-int(both[0]), made))
        made += 1
    part = np.zeros(n, np.int32)
    stack, names = [heap[0][1]], {heap[0][1]: down}
    lead_names = None
    while stack:
        node = stack.pop()
        mine = names.pop(node)
        if node in kids:
            a, b = kids[node]
            names[a], names[b] = np.empty(shards, np.int64), np.empty(shards, np.int64)
            names[a][slots[node]] = mine
            names[b][shards - 1 - slots[node]] = mine
            stack += [a, b]
        elif node == lead:
            lead_names = mine
        else:
            part[node] = mine[0]
    if lead_names is not None:  # rename: the slot that holds a shard's first sum is that shard
        shard_of = np.empty(shards, np.int32)
        shard_of[lead_names] = np.argsort(-first, kind="stable")
        part = shard_of[part]
    return part


def _leaf(size: int, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    out[0] = size
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) for each row, without Python; a null text is measured, and grouped, as an empty one."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = (F.octet_length(body) + ROW_BYTES).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), text_key().alias("key"))


def placed(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) for each group (key binary, total long) of a written table."""
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    limits = [total // (shards * LARGE)]
    while limits[-1] > total // (shards * FINE * max(1, -(-count // CLASS_GROUPS))):
        limits.append(limits[-1] // BAND)
    banded = groups.withColumn("band", sum(((F.col("total") <= x).cast("int") for x in limits), F.lit(0)))

    def heavy(table: pa.Table) -> pa.Table:
        table = table.sort_by([("total", "descending"), ("key", "ascending")])
        part = difference(table.column("total").to_numpy(), shards)
        return pa.table({"key": table.column("key"), "total": table.column("total"), "shard": pa.array(part, pa.int32())})

    large = groups.filter(F.col("total") > limits[0]).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(heavy, "key binary, total long, shard int")
    large = materialize(large, "large")
    held = np.zeros(shards, np.int64)
    for r in large.groupBy("shard").agg(F.sum("total").alias("held")).collect():  # a row for each shard
        held[r.shard] = r.held
    out = large.select("key", "shard")
    bands = banded.filter("band > 0").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).collect()  # a row for each power of BAND
    for r in sorted(bands):
        lack = np.maximum(_level(held, int(held.sum()) + r.total) - held, 0.0)
        where, more = _dealt(banded.filter(F.col("band") == r.band).select("key", "total"), -(-r.n // CLASS_GROUPS), lack)
        held += more
        out = out.unionByName(where)
    return out


def _dealt(groups: DataFrame, classes: int, lack: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(key, shard) for each group of a band, and the bytes that each shard gets; ``lack``: what it should get."""
    shards = len(lack)

    def light(table: pa.Table) -> pa.Table:
        table = table.sort_by([("total", "descending"), ("key", "ascending")])
        sizes = table.column("total").to_numpy()
        share = lack * (sizes.sum() / lack.sum())
        part = difference(sizes, shards, np.round(share.max() - share).astype(np.int64))
        sums = np.zeros(shards, np.int64)
        np.add.at(sums, part, sizes)
        n, longs = len(sizes), pa.list_(pa.int64())
        return pa.table({  # the groups, and one row with the class's partial partition
            "key": pa.array([*table.column("key").to_pylist(), None], pa.binary()), "class": pa.array([table.column("class")[0].as_py()] * (n + 1), pa.int64()),
            "slot": pa.array([*part.tolist(), None], pa.int32()), "sums": pa.array([*[None] * n, sums.tolist()], longs),
        })

    def unit(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        sums = np.array(table.column("sums").to_pylist(), np.int64)
        places = match(sums, lack)
        made = np.zeros(shards, np.int64)
        np.add.at(made, places, sums)
        n = len(sums)
        return pa.table({
            "class": pa.array([*table.column("class").to_pylist(), None], pa.int64()), "unit": pa.array([table.column("unit")[0].as_py()] * (n + 1), pa.int64()),
            "places": pa.array([*places.tolist(), None], pa.list_(pa.int32())), "sums": pa.array([*[None] * n, made.tolist()], pa.list_(pa.int64())),
        })

    keyed = groups.withColumn("class", F.pmod(F.xxhash64("key"), F.lit(classes)).cast("long"))
    slots = materialize(keyed.groupBy("class").applyInArrow(light, "key binary, class long, slot int, sums array<long>"), "slots")
    rows = slots.filter("sums is not null").select("class", "sums").withColumn("unit", F.pmod("class", F.lit(-(-classes // UNIT_CLASSES))).cast("long"))
    matched = materialize(rows.groupBy("unit").applyInArrow(unit, "class long, unit long, places array<int>, sums array<long>"), "matched")
    units = sorted(matched.filter("sums is not null").select("unit", "sums").collect())  # a row for UNIT_CLASSES x CLASS_GROUPS groups
    sums = np.array([r.sums for r in units], np.int64)
    places = match(sums, lack)
    more = np.zeros(shards, np.int64)
    np.add.at(more, places, sums)
    top = groups.sparkSession.createDataFrame([(r.unit, x.tolist()) for r, x in zip(units, places, strict=True)], "unit long, shards array<int>")
    where = matched.filter("sums is null").join(top, "unit").select("class", F.transform("places", lambda x: F.get("shards", x)).alias("shards"))
    return slots.filter("sums is null").join(where, "class").select("key", F.get("shards", F.col("slot")).alias("shard")), more


def match(sums: np.ndarray, lack: np.ndarray) -> np.ndarray:
    """The shard of each slot of partial partitions (rows of ``sums``) that were differenced against their parts of ``lack``.

    The one farthest from its part comes first; its slots in falling order go to the shards in falling order of what they still lack.
    """
    part = lack / lack.sum()
    rest = part * sums.sum()
    out = np.empty(sums.shape, np.int32)
    for i in np.argsort(-np.abs(sums - np.outer(sums.sum(axis=1), part)).max(axis=1), kind="stable"):
        slots, open_ = np.argsort(-sums[i], kind="stable"), np.argsort(-rest, kind="stable")
        out[i, slots] = open_
        rest[open_] -= sums[i, slots]
    return out


def _level(held: np.ndarray, total: int) -> float:
    """The common level to which what is left fills the shards that lie below it."""
    rest = total - int(held.sum())
    rising = np.sort(held).astype(float)
    for k in range(1, len(rising) + 1):
        level = (rising[:k].sum() + rest) / k
        if k == len(rising) or level <= rising[k]:
            return level
    return 0.0


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``; law ``bytes``.

    Equal texts stay together. Slots number the rows of a shard from 0 without gaps. Null text: no
    bytes, crc 0, equal to empty ones. Null doc_id and repeated rows: rows as any other. A group
    larger than a shard's even part fills a shard alone. Rows that tie in all columns get different slots. An empty table gives an empty result.
    Other columns, whatever their names, are not read; texts are measured in the JVM, whole.
    ``grown_shard`` belongs to another law and is null.
    """
    rows = materialize(measured(docs), "measured")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("total")), "groups")
    where = materialize(placed(groups, shards), "placed").withColumnRenamed("key", "k")
    # a group may hold a third of all rows: both sides are exchanged anew, so the join can split it
    dealt = rows.join(where, F.col("key") == F.col("k")).select("doc_id", "size", "text_crc32", "shard")
    dealt = materialize(dealt, "dealt")
    out = dense_ids(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot", dealt.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
