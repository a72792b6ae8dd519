"""Suffix-array dedup of long substrings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus.

1. Texts are packed into *units* of a few MB and written once. Of equal whole texts all but the first are
   known to go entirely; they take no further part.
2. Each window of ``length`` bytes has an *anchor*: the q-gram in it with the least hash, the leftmost of
   ties. Equal windows have equal anchors at equal places, so windows are dealt by anchor and meet in one task.
   Anchors that occur once in the corpus are found from their hashes alone and need no further work.
3. Segments (text under the windows of one anchor occurrence) of the other anchors are dealt by anchor.
   Per class of anchors a suffix array to depth ``length`` is built by bucket-pointer refinement: suffixes are put into
   buckets by their first 8 bytes; a bucket is refined by sorting on the bucket identifiers at later offsets, and the
   refined identifiers serve at the offsets of the next refinement (8, 24, 72, 100 bytes). All windows of
   a final bucket but the first repeat earlier text.
4. The marks return to their units, where the remaining bytes are assembled.

Equal segments within a unit are sent once, so a passage that is everywhere costs a row per unit. An anchor that
occurs very often between ever new texts is hot: its windows are dealt one by one, by a hash of their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialize, text_bytes

LENGTH, GRAM = 100, 24
#: Text bytes of a unit, of a class of anchor hashes, and of a class of segments, each from the least to the most (sizes of work,
#: not limits). A unit sends a row to each class, so both grow with the corpus: else at 100 TB each hash would be a row of its own.
UNIT_BYTES, HASH_CLASS_BYTES, SEGMENT_CLASS_BYTES = (4_000_000, 64_000_000), (32_000_000, 512_000_000), (2_000_000, 8_000_000)
#: Occurrences from which an anchor is hot: its windows are dealt by their own content.
HOT = 4096
#: Window starts that are hashed at once.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: Bits of a hash that name an anchor.
_NAME = ~_U(15)


# --------------------------------------------------------------------------- anchors
def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, _U), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


_tables: dict[str, np.ndarray] = {}


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each q-gram; it depends on its bytes alone."""
    n = len(x)
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK + 4 * LENGTH)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    upto = np.zeros(n + 1, _U)
    np.cumsum((x.astype(_U) + _U(1)) * _tables["up"][:n], out=upto[1:])
    h = (upto[gram:] - upto[:-gram]) * _tables["down"][: n - gram + 1]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def segments(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, windows) of the runs of windows with one anchor; windows lie within [start, end) pairs."""
    hashes, firsts, counts = [], [], []
    width = length - gram + 1
    for lo in range(0, len(x) - length + 1, CHUNK):
        part = x[lo : min(lo + CHUNK, len(x) - length + 1) + length - 1]
        h = _gram_hashes(part, gram)
        keys = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        blocks = np.concatenate([keys, np.full(-len(keys) % width, ~_U(0))]).reshape(-1, width)
        ahead, behind = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keys) - width + 1
        anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)
        at = np.arange(lo, lo + n)
        doc = np.searchsorted(starts, at, "right") - 1
        inside = np.flatnonzero((doc >= 0) & (at + length <= ends[doc]))
        if not len(inside):
            continue
        a = anchor[inside]
        new = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(inside) != 1)])
        hashes.append(h[a[new]])
        firsts.append(inside[new] + lo)
        counts.append(np.diff(np.r_[new, len(inside)]))
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)


# --------------------------------------------------------------------------- bucket-pointer refinement
def _ranks(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers in key order: equal keys, equal identifiers."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return out


def _refine(columns: list[np.ndarray]) -> np.ndarray:
    """Identifiers of the buckets that the pointers in ``columns`` (first: the bucket so far) make together."""
    out = columns[0]
    for c in columns[1:]:
        bits = int(c.max()).bit_length() if len(c) else 0
        if int(out.max() if len(out) else 0).bit_length() + bits > 62:
            out = _ranks(out)
        out = (out << bits) | c
    return _ranks(out)


def depths(length: int) -> list[tuple[int, list[int]]]:
    """(depth reached, later offsets) of the refinements after 8 bytes: each takes up to two offsets at which the pointers reach depth."""
    out, depth = [], 8
    while depth < length:
        now = min(3 * depth, length)
        offsets = [depth, now - depth] if now > 2 * depth else [now - depth]
        out.append((now, offsets))
        depth = now
    return out


def buckets(text: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of each window: windows are equal just if their buckets are.

    Segment i is ``text[firsts[i]: firsts[i] + counts[i] + length - 1]``; segments lie one after the other.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]
    at = _spread(firsts, counts + length - 8)
    pointers = np.zeros(len(text), np.int64)
    pointers[at] = _ranks(np.ascontiguousarray(words[at]).view(">u8").ravel().astype(_U))
    for depth, offsets in depths(length):
        at = _spread(firsts, counts + length - depth)
        refined = _refine([pointers[at], *[pointers[at + o] for o in offsets]])
        pointers[at] = refined
    return pointers[at], at


def _spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... (counts[i] of them) for each i."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def repeats(text: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, end) of the byte runs under windows that equal an earlier one; offsets are within the segment."""
    sizes = counts + length - 1
    firsts = np.cumsum(sizes) - sizes
    bucket, at = buckets(text, firsts, counts, length)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    again = np.empty(len(at), bool)
    again[order] = np.r_[False, ordered[1:] == ordered[:-1]]
    segment = np.repeat(np.arange(len(counts)), counts)
    hit = np.flatnonzero(again)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(segment[hit]) != 0)])
    last = np.r_[new[1:], len(hit)] - 1
    s = segment[hit[new]]
    return s, at[hit[new]] - firsts[s], at[hit[last]] - firsts[s] + length


# --------------------------------------------------------------------------- units
def units(docs: DataFrame, unit_bytes: int = UNIT_BYTES[0]) -> DataFrame:
    """(unit, doc_ids, sizes, keys, body): texts packed and compressed; unit is unique, keys are digests of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        unit = (task.partitionId() if task else 0) << 32
        ids: list = []
        bodies: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
            body = zstandard.ZstdCompressor(3).compress(b"".join(bodies))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
            values = [[unit], [ids], [[len(x) for x in bodies]], [keys], [body]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["unit", "doc_ids", "sizes", "keys", "body"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                bodies.append(x or b"")
                held += len(bodies[-1]) + 64
                if held >= unit_bytes:
                    yield packed()
                    unit, ids, bodies, held = unit + 1, [], [], 0
        if ids:
            yield packed()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return text_bytes(plain, "doc_id").mapInArrow(run, "unit long, doc_ids array<long>, sizes array<int>, keys array<binary>, body binary")


class Unit:
    """The texts of a unit that take part, and their segments."""

    def __init__(self, sizes: list[int], body: bytes, skip: list[int] | None):
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if body else np.zeros(0, np.uint8)
        self.ends = np.cumsum(sizes).astype(np.int64)
        self.starts = self.ends - np.array(sizes, np.int64)
        self.skip = np.zeros(len(sizes), bool)
        self.skip[skip or []] = True

    def segments(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, anchor hash, first window start in the unit, windows)."""
        used = np.flatnonzero(~self.skip & (self.ends - self.starts >= length))
        if not len(used):
            return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, first, count = segments(self.text, self.starts[used], self.ends[used], length, gram)
        return used[np.searchsorted(self.starts[used], first, "right") - 1], h, first, count


def _hash_classes(h: np.ndarray, classes: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(classes)).astype(np.int64)


def _masked(cls: np.ndarray, masks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors, by their classes ``cls``, the masks (cls, bits, hot) of a unit name as repeated, and which as hot.

    Anchors are sorted by class once and each mask takes its slice, so a unit's work does not grow with the corpus' classes.
    """
    keep, hot = np.zeros(len(cls), bool), np.zeros(len(cls), bool)
    order = np.argsort(cls, kind="stable")
    ordered, named = cls[order], np.array([m["cls"] for m in masks], np.int64)
    starts = np.searchsorted(ordered, named)
    sizes = np.searchsorted(ordered, named, "right") - starts
    widths = (sizes + 7) // 8
    at, bit = order[_spread(starts, sizes)], _spread(8 * (np.cumsum(widths) - widths), sizes)
    for into, name in ((keep, "bits"), (hot, "hot")):
        data = b"".join(bytes(w) if m[name] is None else m[name] for m, w in zip(masks, widths.tolist(), strict=True))
        into[at] = np.unpackbits(np.frombuffer(data, np.uint8))[bit]
    return keep, hot


def later_copies(found: DataFrame, length: int) -> DataFrame:
    """(unit, skip): in each unit the documents that equal an earlier one as a whole and are at least ``length`` long."""
    rows = found.select("unit", F.posexplode(F.arrays_zip("doc_ids", "sizes", "keys")).alias("ord", "x"))
    rows = materialize(rows.filter(F.col("x.sizes") >= length).select("unit", "ord", F.col("x.doc_ids").alias("doc_id"), F.col("x.keys").alias("key")), "rows")
    per = rows.groupBy("key").agg(F.min(F.struct("doc_id", "unit", "ord")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leads = materialize(per.select(F.col("key").alias("k"), F.col("lead.unit").alias("u"), F.col("lead.ord").alias("o")), "leads")
    later = rows.join(leads, F.col("key") == F.col("k")).filter("unit <> u or ord <> o")
    return materialize(later.groupBy("unit").agg(F.collect_list("ord").alias("skip")), "skips")


def repeated_anchors(found: DataFrame, classes: int, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """(unit, cls, bits, hot): which of the unit's distinct anchor hashes of a class, in order, occur twice in the corpus, and which at least ``hot`` times.

    ``found``: units with ``skip``. The lowest four bits of a hash that is sent are the length of its count in the unit.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, sizes, body, skip in zip(*(b.column(c).to_pylist() for c in ("unit", "sizes", "body", "skip")), strict=True):
                h, n = np.unique(Unit(sizes, body, skip).segments(length, gram)[1] & _NAME, return_counts=True)
                cls = _hash_classes(h, classes)
                order = np.argsort(cls, kind="stable")
                h = (h | np.minimum(np.frexp(n.astype(float))[1], 15).astype(_U))[order]
                cls = cls[order]
                cut = np.flatnonzero(np.r_[True, np.diff(cls) != 0]) if len(h) else []
                parts = [p.tobytes() for p in np.split(h, cut[1:])] if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(parts), pa.int64()), pa.array(cls[cut] if len(h) else [], pa.int64()), pa.array(parts, pa.binary())], ["unit", "cls", "hashes"])

    def often(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
        every = np.concatenate(parts)
        _, inverse = np.unique(every & _NAME, return_inverse=True)
        n = np.bincount(inverse, np.exp2((every & ~_NAME).astype(float) - 1))[inverse]  # no more than there are
        masks = []
        for least in (2, hot):
            hit = np.split(n >= least, np.cumsum([len(p) for p in parts])[:-1])
            masks.append(pa.array([np.packbits(x).tobytes() if x.any() else None for x in hit], pa.binary()))
        out = pa.table({"unit": table.column("unit"), "cls": table.column("cls"), "bits": masks[0], "hot": masks[1]})
        return out.filter(out.column("bits").is_valid())

    made = found.select("unit", "sizes", "body", "skip").mapInArrow(anchors, "unit long, cls long, hashes binary")
    return made.groupBy("cls").applyInArrow(often, "unit long, cls long, bits binary, hot binary")


def marked(found: DataFrame, hash_classes: int, segment_classes: int, length: int, gram: int) -> DataFrame:
    """(unit, marks): runs of repeated bytes, int32 triples of document, start and end in it. ``found``: units with ``skip`` and ``masks``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, ids, sizes, body, skip, masks in zip(*(b.column(c).to_pylist() for c in ("unit", "doc_ids", "sizes", "body", "skip", "masks")), strict=True):
                u = Unit(sizes, body, skip)
                doc, h, first, count = u.segments(length, gram)
                distinct = np.unique(h & _NAME)
                cls = _hash_classes(distinct, hash_classes)
                keep, hot = _masked(cls, masks)
                at = np.searchsorted(distinct, h & _NAME)
                few, many = np.flatnonzero(keep[at] & ~hot[at]), np.flatnonzero(hot[at])
                # windows of a hot anchor part company: each is a segment of its own, dealt by its content
                doc = np.concatenate([doc[few], np.repeat(doc[many], count[many])])
                first = np.concatenate([first[few], _spread(first[many], count[many])])
                route = np.concatenate([h[few], np.zeros(len(first) - len(few), _U)])
                alone = np.arange(len(first)) >= len(few)
                count = np.concatenate([count[few], np.ones(len(first) - len(few), np.int64)])
                seen: set[bytes] = set()
                sent, local = [], []
                for i in np.lexsort((first, doc, [-(2**63) if ids[d] is None else ids[d] for d in doc])).tolist():
                    a, z = int(first[i]), int(first[i] + count[i]) + length - 1
                    piece = u.text[a:z].tobytes()
                    if piece in seen:
                        local.append((int(doc[i]), a - int(u.starts[doc[i]]), z - int(u.starts[doc[i]])))
                    else:
                        seen.add(piece)
                        sent.append(i)
                        if alone[i]:
                            route[i] = xxhash.xxh64_intdigest(piece)
                rows = []
                if local:  # a class of its own, only passed on; runs are joined, or a periodic text would mark each of its bytes
                    runs = [(d, *span) for d, marks in groupby(sorted(local), itemgetter(0)) for span in _union([m[1:] for m in marks])]
                    rows.append((unit, -1 - unit % segment_classes, None, None, None, None, None, np.array(runs, np.int32).tobytes()))
                sent = np.array(sent, np.int64)
                where = (route[sent] % _U(segment_classes)).astype(np.int64)
                sent = sent[np.argsort(where, kind="stable")]
                where = np.sort(where)
                for part in np.split(sent, np.flatnonzero(np.diff(where)) + 1) if len(sent) else []:
                    text = b"".join(u.text[first[i] : first[i] + count[i] + length - 1].tobytes() for i in part)
                    text = zstandard.ZstdCompressor(1).compress(text)
                    rows.append((unit, int(route[part[0]] % _U(segment_classes)), [ids[d] for d in doc[part]], doc[part].tolist(), (first[part] - u.starts[doc[part]]).tolist(), count[part].tolist(), text, None))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                names = ["unit", "cls", "ids", "docs", "firsts", "counts", "text", "marks"]
                for at in range(0, len(rows), 1000):
                    some = rows[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names)

    def refine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        passed = [(r["unit"], r["marks"]) for r in rows if r["marks"] is not None]
        rows = [r for r in rows if r["marks"] is None]
        if rows:
            unit = np.repeat([r["unit"] for r in rows], [len(r["docs"]) for r in rows])
            doc, first, count = (np.array([x for r in rows for x in r[c]], np.int64) for c in ("docs", "firsts", "counts"))
            rank = np.array([-(2**63) if x is None else x for r in rows for x in r["ids"]], np.int64)
            text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["text"]) for r in rows), np.uint8)
            size = count + length - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((first, doc, unit, rank))  # earlier text comes first
            text = text[_spread(begin[order], size[order])]
            s, lo, hi = repeats(text, count[order], length)
            s = order[s]
            out = np.column_stack([doc[s], first[s] + lo, first[s] + hi]).astype(np.int32)
            by = np.argsort(unit[s], kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(unit[s][by])) + 1) if len(by) else []:
                passed.append((int(unit[s][part[0]]), out[part].tobytes()))
        return pa.table({"unit": pa.array([x[0] for x in passed], pa.int64()), "marks": pa.array([x[1] for x in passed], pa.binary())})

    schema = "unit long, cls long, ids array<long>, docs array<int>, firsts array<int>, counts array<int>, text binary, marks binary"
    sent = found.select("unit", "doc_ids", "sizes", "body", "skip", "masks").mapInArrow(send, schema)
    return sent.groupBy("cls").applyInArrow(refine, "unit long, marks binary")


def _between(limits: tuple[int, int], size: int) -> int:
    return min(max(size, limits[0]), limits[1])


def _estimate(docs: DataFrame) -> int:
    """About how many bytes the documents have, as the optimizer sees it before anything is read."""
    return int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit_bytes: int | None = None, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]), a row for each row of ``docs``.

    ``spans``: (start, end) of the maximal removed runs of bytes; ``kept``: the remaining bytes. Null text: empty. Null
    doc_id: before all others. Rows that share a doc_id follow each other in the order of the input's layout;
    the first keeps its text. Texts shorter than ``length`` are whole. An empty table gives an empty result. A text is held whole by the
    task that packs its unit; its windows are hashed in chunks. Columns but doc_id and text are not read.
    """
    found = materialize(units(docs, unit_bytes or _between(UNIT_BYTES, _estimate(docs) // 25_000)), "units")
    total = found.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    hash_classes = max(16, -(-total // _between(HASH_CLASS_BYTES, total // 8192)))
    segment_classes = max(32, -(-total // _between(SEGMENT_CLASS_BYTES, total // 100_000)))
    skips = later_copies(found, length)
    anchors = repeated_anchors(found.drop("doc_ids", "keys").join(skips, "unit", "left"), hash_classes, length, gram, hot)
    masks = materialize(anchors.groupBy("unit").agg(F.collect_list(F.struct("cls", "bits", "hot")).alias("masks")).join(skips, "unit", "left"), "masks")
    marks = marked(found.drop("keys").join(masks, "unit"), hash_classes, segment_classes, length, gram)
    marks = materialize(marks, "marks").groupBy("unit").agg(F.collect_list("marks").alias("marks"))
    last = found.drop("keys").join(skips, "unit", "left").join(marks, "unit", "left")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, body, skip, hits in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "sizes", "body", "skip", "marks")), strict=True):
                u = Unit(sizes, body, skip)
                runs = np.frombuffer(b"".join(hits or []), np.int32).reshape(-1, 3)
                runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
                at = np.searchsorted(runs[:, 0], np.arange(len(sizes) + 1))
                columns: list[list] = [[] for _ in range(6)]
                for d, size in enumerate(sizes):
                    spans = [(0, size)] if u.skip[d] else _union(runs[at[d] : at[d + 1], 1:].tolist())
                    text = u.text[u.starts[d] : u.ends[d]].tobytes()
                    cuts = [0, *(x for s in spans for x in s), size]
                    kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
                    for c, v in zip(columns, (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in spans], kept), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                n = 6 if with_text else 4
                arrays = [pa.array(ids, pa.int64()), *[pa.array(v, k) for v, k in zip(columns[:n], kinds[:n], strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: n + 1])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: long, end: long>>, kept binary" if with_text else "")
    return last.mapInArrow(assemble, schema)


def _union(spans: list[Sequence[int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out
