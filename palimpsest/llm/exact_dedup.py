"""Exact dedup against history through a minimal perfect hash.

The distinct digests of the *historical* documents are hashed by a level-wise minimal perfect hash
(one small function per bucket of the digest space): every digest gets its own slot from 0 to n - 1,
and the slot holds the full digest, the locator of its winner and the number of its rows. An incoming
digest probes exactly one slot and is a member only if all its bytes equal the slot's; nonmembers are
grouped among themselves. Winners of both kinds are then joined to the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bodies, kept_rows, materialize, text_key, tidy

#: Mean digests of a bucket: what one task hashes at once.
BUCKET_DIGESTS = 20_000
#: Bits of a level for each digest that is still without a slot.
GAMMA = 2
MAX_LEVELS = 40


# --------------------------------------------------------------------------- minimal perfect hash
def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest (rows of four words) for a level."""
    with np.errstate(over="ignore"):
        h = words[:, 0] ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        for i in range(1, words.shape[1]):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, i]
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(len(digests), -1)


class PerfectHash:
    """Level-wise minimal perfect hash of distinct digests of equal length.

    Each level is a bit array; a digest that alone hits a bit of the level owns it, the others go on
    to the next level. A slot is the rank of the owned bit over all levels. What is left after
    ``MAX_LEVELS`` (in practice nothing) is listed, so the function is total and minimal always.
    """

    def __init__(self, digests: list[bytes]):
        words, left = _words(digests) if digests else np.zeros((0, 4), "<u8"), np.arange(len(digests))
        self.levels: list[np.ndarray] = []
        self.bases: list[int] = []
        base = 0
        while len(left) and len(self.levels) < MAX_LEVELS:
            size = max(64, GAMMA * len(left))
            at = (_mix(words[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            alone = hits == 1
            ranks = np.where(alone, np.cumsum(alone) - 1, -1)
            self.levels.append(ranks)
            self.bases.append(base)
            base += int(alone.sum())
            left = left[~alone[at]]
        self.listed = {digests[i]: base + k for k, i in enumerate(left)}
        self.size = len(digests)

    def slots(self, digests: list[bytes]) -> np.ndarray:
        """The slot that each digest must have if it is a member; -1 where no slot can hold it."""
        out = np.full(len(digests), -1, np.int64)
        if not digests:
            return out
        words, left = _words(digests), np.arange(len(digests))
        for level, (ranks, base) in enumerate(zip(self.levels, self.bases, strict=True)):
            if not len(left):
                break
            got = ranks[(_mix(words[left], level) % np.uint64(len(ranks))).astype(np.int64)]
            out[left[got >= 0]] = got[got >= 0] + base
            left = left[got < 0]
        for i in left:
            out[i] = self.listed.get(digests[i], -1)
        return out


# --------------------------------------------------------------------------- operator
def digests(docs: DataFrame, *others: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, ``others``...): SHA-256 of the whole text with A-Z lower-cased; a null text counts as empty.

    Only texts go to Python, and only digests come back. (``translate`` for A-Z would stay in the JVM, but makes an object
    of each character: measured four times as slow as this.)
    """

    def digest(texts: pa.Array) -> pa.Array:
        tidy()
        return pa.array([hashlib.sha256(x.lower()).digest() for x in bodies(texts)], pa.binary())

    made = F.arrow_udf(digest, "binary")(F.col(f"`{text_col}`").cast("binary"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), made.alias("digest"), *others)


def _per_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("win"), F.count(F.lit(1)).alias("n"))


def probe(history: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Per distinct digest of both sides: (digest, win, n).

    ``history`` and ``incoming`` hold one row per distinct digest of their side. Each bucket of the
    digest space builds its perfect hash from history, fills the slots and probes them with the
    incoming digests: a member joins its slot's rows, a nonmember stands for itself.
    """
    both = history.select("digest", "win", "n", F.lit(True).alias("old")).unionByName(incoming.select("digest", "win", "n", F.lit(False).alias("old")))

    def run(table: pa.Table) -> pa.Table:
        old = table.filter(pc.field("old"))
        new = table.filter(~pc.field("old"))
        held = old.column("digest").to_pylist()
        mph = PerfectHash(held)
        slot_digest, win, n = np.empty(len(held), object), np.empty(len(held), object), np.zeros(len(held), np.int64)
        at = mph.slots(held)
        slot_digest[at], win[at], n[at] = held, old.column("win").to_pylist(), old.column("n").to_numpy()
        asked = new.column("digest").to_pylist()
        rest = []
        for d, s, w, k in zip(asked, mph.slots(asked).tolist(), new.column("win").to_pylist(), new.column("n").to_pylist(), strict=True):
            if s >= 0 and slot_digest[s] == d:  # all bytes are compared
                n[s] += k
                if w is not None and (win[s] is None or w > win[s]):
                    win[s] = w
            else:
                rest.append((d, w, k))
        out = [*zip(slot_digest, win, n.tolist(), strict=True), *rest]
        kinds = (pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(zip(("digest", "win", "n"), kinds, strict=True))})

    keyed = both.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(run, "digest binary, win long, n long")


def split_history(rows: DataFrame) -> int | None:
    """Rows up to this doc_id are the history: the middle of the id range. None: there are no ids."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return None if low is None else (low + high) // 2


def exact_groups(docs: DataFrame, history_until: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Rows with doc_id up to ``history_until`` (default: the middle of the id range) are the history.
    Of equal normalised texts the largest doc_id stays. Nulls: a null text is an empty one, a null
    doc_id is below all others (history). Repeated rows: one of the rows with the largest doc_id stays.
    An empty table gives an empty result. Only doc_id and text are read, whatever else there is. A text is hashed
    whole; a task holds 512 texts at once.
    """
    rows = materialize(digests(docs, F.monotonically_increasing_id().alias("uid")), "digests")
    until = split_history(rows) if history_until is None else history_until
    old = F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(until)) if until is not None else F.lit(True)
    buckets = max(16, -(-rows.count() // BUCKET_DIGESTS))
    winners = materialize(probe(_per_digest(rows.filter(old)), _per_digest(rows.filter(~old)), buckets), "winners")
    # A third of all rows may share a digest: both sides are exchanged anew here, so that the join can split it.
    joined = rows.join(winners.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    joined = joined.select("doc_id", "uid", F.col("win").alias("keep_id"), F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    first = _first_of_ties(rows, winners)
    marked = joined.join(first.withColumnRenamed("uid", "other"), F.col("uid") == F.col("other"), "left_anti") if first is not None else joined
    one = marked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if first is not None:
        rest = joined.join(first, "uid", "left_semi").withColumn("kept", F.lit(False))
        one = one.unionByName(rest)
    return one.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _first_of_ties(rows: DataFrame, winners: DataFrame) -> DataFrame | None:
    """uid of rows that repeat a winner's doc_id and text, all but one; None if there are none (the usual case)."""
    pairs = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("same"), F.min("uid").alias("first")).filter("same > 1")
    pairs = materialize(pairs, "ties")
    if pairs.isEmpty():
        return None
    p = pairs.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), "first")
    tied = rows.join(p, (rows["digest"] == p["d"]) & rows["doc_id"].eqNullSafe(p["i"])).filter("uid <> first")
    return materialize(tied.select("uid"), "tied")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct normalised text.

    The row with the largest doc_id stays; of several with it, the one whose text as it stands has the least digest. Null ids
    and texts, repeated rows and an empty table as in :func:`exact_groups`; other columns, whatever their names, are carried along.
    """
    rows = materialize(digests(docs, text_key().alias("key")), "digests")
    until = split_history(rows)
    old = F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(until)) if until is not None else F.lit(True)
    buckets = max(16, -(-rows.count() // BUCKET_DIGESTS))
    winners = probe(_per_digest(rows.filter(old)), _per_digest(rows.filter(~old)), buckets)
    repeated = materialize(winners.filter("n > 1").select(F.col("digest").alias("d"), "win"), "repeated")
    # a third of all rows may share a digest: the join may split it
    members = materialize(rows.join(repeated, F.col("digest") == F.col("d")).select("digest", "doc_id", "key", F.col("doc_id").eqNullSafe(F.col("win")).alias("top")), "members")
    tops = members.filter("top").groupBy("digest", F.col("doc_id").alias("id"), "key").agg(F.count(F.lit(1)).alias("same"))
    least = tops.groupBy("digest").agg(F.min("key").alias("stay"))
    tops = materialize(tops.join(least, "digest").select("id", "key", "same", (F.col("key") == F.col("stay")).alias("stays")), "tops")
    drops = members.filter("not top").select(F.col("doc_id").alias("id"), "key").distinct().unionByName(tops.filter("not stays").select("id", "key"))
    return kept_rows(docs, materialize(drops, "drops"), tops.filter("stays and same > 1").select("id", "key"))
