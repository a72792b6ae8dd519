"""SimHash near-dedup with covering locality-sensitive hashing.

A random linear map gives each of the 64 bit positions a vector of r + 1 bits. Each nonzero vector v of
r + 1 bits is a table; its mask keeps the positions whose vector has an odd inner product with v. For any r
differing positions some v is orthogonal to all their vectors, so two fingerprints within radius r agree
under some mask: no pair within the radius is missed (2^(r+1) - 1 tables). Buckets yield spanning
trees, not pairs; components come from alternating star contractions over those trees.

A *scheme* says which fingerprints link two texts. ``SHINGLES`` is one fingerprint of three-word shingles. Of near copies
it links few: words that differ change three shingles each. ``NEAR``, for the pipeline, takes texts as near if one of four
fingerprints of their distinct words lies within the radius, each with masks of its own, and the fingerprints of their
five-word shingles differ in at most a fifth of the bits (as they do at a similarity of 0.8; unrelated texts differ in half).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bodies, discard, kept_rows, materialize, partitions_for, text_key, tidy

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Buckets up to this size are compared directly; larger ones are split by 16-bit blocks first.
DIRECT = 4096
#: Shingles that are hashed at once.
CHUNK = 1 << 16


# --------------------------------------------------------------------------- fingerprints
@dataclass(frozen=True)
class Print:
    """A fingerprint: of ``n``-word shingles with repeats, or of distinct ones; XXH64 with ``seed``."""

    n: int = SHINGLE
    seed: int = SEED
    distinct: bool = False


@dataclass(frozen=True)
class Scheme:
    """Texts link if one of ``prints`` differs in at most ``radius`` bits and ``guard``, if any, in at most ``guard_radius``."""

    prints: tuple[Print, ...] = (Print(),)
    radius: int = RADIUS
    guard: Print | None = None
    guard_radius: int = 0

    @property
    def columns(self) -> list[str]:
        return [f"fp{i}" for i in range(len(self.prints))] + (["guard"] if self.guard else [])


SHINGLES = Scheme()
NEAR = Scheme(tuple(Print(1, seed, True) for seed in (1, 2, 3, 4)), RADIUS, Print(5), 13)


def fingerprint(body: bytes, n: int = SHINGLE, seed: int = SEED, distinct: bool = False) -> int:
    """SimHash of a text: A-Z lower-cased, ASCII-space words, n-word shingles (fewer words: the whole sequence; none: zero)."""
    return _of(body.lower().split(), Print(n, seed, distinct))


def _of(words: list[bytes], kind: Print) -> int:
    if not words:
        return 0
    n = min(kind.n, len(words))
    shingles = words if n == 1 else map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))
    if kind.distinct:
        shingles = set(shingles)
    count = len(shingles) if n == 1 or kind.distinct else len(words) - n + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, kind.seed) for s in shingles), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, count, CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, scheme: Scheme = SHINGLES) -> DataFrame:
    """(doc_id, key, a signed long for each fingerprint of the scheme) for each row; only texts go to Python, only fingerprints come back."""
    kinds = [*scheme.prints, *([scheme.guard] if scheme.guard else [])]

    def run(texts: pa.Array) -> pa.Array:
        tidy()
        out = np.zeros((len(texts), len(kinds)), np.uint64)
        for row, body in enumerate(bodies(texts)):
            words = body.lower().split()
            out[row] = [_of(words, k) for k in kinds]
        return pa.StructArray.from_arrays([pa.array(out[:, i].view(np.int64)) for i in range(len(kinds))], scheme.columns)

    made = F.arrow_udf(run, "struct<" + ", ".join(f"{c}: long" for c in scheme.columns) + ">")(F.col("text").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), made.alias("f")).select("doc_id", "key", "f.*")


# --------------------------------------------------------------------------- covering tables
def masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits, as signed 64-bit numbers.

    The positions' vectors are dealt evenly over the nonzero vectors, in an order that the seed fixes.
    """
    kinds = 2 ** (radius + 1) - 1
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % kinds + 1)
    out = []
    for v in range(1, kinds + 1):
        m = sum(1 << i for i, a in enumerate(vectors) if int(a & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def trees(fps: np.ndarray, radius: int = RADIUS, split: bool = True, guards: np.ndarray | None = None, guard_radius: int = 0) -> list[tuple[int, int]]:
    """Index pairs (root, member) that join the ``fps`` linked within ``radius`` (and ``guards`` within theirs), at most len - 1 a block.

    Each round takes a fingerprint and finds its links among those not reached yet, so memory is
    linear. Above DIRECT fingerprints, only those that share one of radius + 1 equal blocks are compared:
    fingerprints within the radius always share one.
    """
    if split and len(fps) > DIRECT:
        out, width = [], BITS // (radius + 1)
        for j in range(radius + 1):
            block = (fps >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
            order = np.argsort(block, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(run) > 1:
                    out += [(int(run[a]), int(run[b])) for a, b in trees(fps[run], radius, False, None if guards is None else guards[run], guard_radius)]
        return out
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if guards is not None:
                near &= np.bitwise_count(guards[left] ^ guards[at]) <= guard_radius
            if near.any():
                got = left[near].tolist()
                out += [(root, x) for x in got]
                front += got
                left = left[~near]
    return out


def links(nodes: DataFrame, rows: int, scheme: Scheme = SHINGLES) -> DataFrame:
    """(u, v) spanning links among ``nodes`` (uid, the scheme's fingerprints; no two alike), u > v."""
    tables = [(f"fp{i}", m) for i in range(len(scheme.prints)) for m in masks(scheme.radius, seed=7 + i)]
    every = np.array([m for _, m in tables], np.int64)
    guard = ["guard"] if scheme.guard else []
    each = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col(c).alias("fp")) for t, (c, _) in enumerate(tables)])
    keyed = nodes.select("uid", *guard, F.explode(each).alias("x")).select("uid", "x.*", *guard)
    masked = F.col("fp").bitwiseAND(F.get(F.array(*map(F.lit, every.tolist())), F.col("t").cast("int")))
    parts = partitions_for(nodes.sparkSession, rows * len(tables), 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        got = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not got:
            return
        uid, t, fp, *guards = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        masked = fp & every[t]
        order = np.lexsort((uid, masked, t))
        cut = np.flatnonzero((np.diff(masked[order]) != 0) | (np.diff(t[order]) != 0)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(fp)]
        u, v = [], []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            of = order[a:b]
            held = guards[0][of].view(np.uint64) if guards else None
            for x, y in trees(fp[of].view(np.uint64), scheme.radius, True, held, scheme.guard_radius):
                u.append(max(uid[of[x]], uid[of[y]]))
                v.append(min(uid[of[x]], uid[of[y]]))
        pairs = np.unique(np.array([u, v], dtype=np.int64).reshape(2, -1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    return keyed.repartition(parts, "t", masked).mapInArrow(run, "u long, v long")


# --------------------------------------------------------------------------- components
def _apart(column: str):
    """The same key in another guise: the exchange of an aggregate is not taken over, so the join can split a hub."""
    return F.bitwise_not(F.col(column))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge (u > v).

    Alternating large-star and small-star contractions until one changes no edge; each round is written to the shared folder and the one
    before is deleted. A round costs rows in proportion to the edges and their number falls as components contract.
    """
    edges = materialize(edges.distinct(), "edges")
    while True:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")).select(_apart("a").alias("k"), "m")
        large = both.filter("b > a").withColumn("k", _apart("a")).join(least, "k").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.withColumn("k", _apart("u")).join(least.select(_apart("u").alias("k"), "m"), "k")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.distinct(), "edges")
        # as many edges, none of them new: nothing has changed
        same = edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty()
        discard(large)
        discard(before)
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(the scheme's fingerprints, low, n, root) for each distinct combination in the written table ``rows``: ``root`` names its component.

    ``low``: the smallest (doc_id is null, doc_id, key) of its n rows.
    """
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    nodes = rows.groupBy(*scheme.columns).agg(F.min(least).alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    roots = components(links(nodes, nodes.count(), scheme))
    return materialize(nodes.join(roots, nodes["uid"] == roots["node"], "left").select(*scheme.columns, "low", "n", F.coalesce("root", "uid").alias("root")), "named")


def _with_lows(named: DataFrame) -> DataFrame:
    """``named`` with ``first`` (the component's smallest ``low``) and ``size`` (its rows) in place of low, n and root."""
    groups = named.groupBy("root").agg(F.min("low").alias("first"), F.sum("n").alias("size")).select(_apart("root").alias("k"), "first", "size")
    return named.withColumn("k", _apart("root")).join(groups, "k").drop("k", "low", "n", "root")


def _matched(rows: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with what ``classes`` says of their fingerprints; a third of all rows may share them, and the join may split them."""
    renamed = classes.withColumnsRenamed({c: f"_{c}" for c in columns})
    on = [F.col(c) == F.col(f"_{c}") for c in columns]
    return rows.join(renamed, on).drop(*[f"_{c}" for c in columns])


def near_groups(docs: DataFrame, scheme: Scheme = SHINGLES) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``; ``fingerprint`` is the scheme's first.

    Fingerprints link as the scheme says (default: at 3 or fewer differing bits). A text without words has fingerprint zero and
    links like any other. Null text: no words. Null doc_id: never the smallest; a component of only such
    rows has a null component_id. Repeated rows and equal texts share a fingerprint. An empty table gives
    an empty result. Only doc_id and text are read. A text is read whole; beside it a task holds its words and eight bytes a shingle.
    """
    rows = materialize(fingerprints(docs, scheme), "fingerprints")
    classes = materialize(_with_lows(_rooted(rows, scheme)).select(*scheme.columns, F.col("first.doc_id").alias("component_id")), "classes")
    out = _matched(rows, classes, scheme.columns)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = NEAR) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    The smallest doc_id stays, a null one only if there is no other; of several with it the one whose text has the smallest
    digest, and one row of those. Rows that share a doc_id, or have none, stay each for its own component.
    """
    rows = materialize(fingerprints(docs, scheme), "fingerprints")
    classes = materialize(_with_lows(_rooted(rows, scheme)).filter("size > 1").select(*scheme.columns, "first"), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    members = materialize(_matched(rows, classes, scheme.columns).select(F.col("doc_id").alias("id"), "key", stays.alias("stays")), "members")
    drops = materialize(members.filter("not stays").select("id", "key").distinct(), "drops")
    ties = materialize(members.filter("stays").groupBy("id", "key").agg(F.count(F.lit(1)).alias("same")).filter("same > 1"), "ties")
    return kept_rows(docs, drops, ties.select("id", "key"))
