"""Snapshots, runs, recovery and the durable store."""

import random

import pytest
from model import Model
from pyspark.sql import functions as F

from palimpsest.functions import cells, codec
from palimpsest.operators import load_report, runs, snapshot
from palimpsest.plans.store import Conflict, Store, tier
from palimpsest.schema import MUTATION
from palimpsest.sources import lines, run_bytes, wal, workload
from palimpsest.sources import runs as run_files
from palimpsest.streaming import ingest


def log(spark, rows):
    return spark.createDataFrame([(i, k, v, e) for i, (k, v, e) in enumerate(rows)], MUTATION)


def state(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_rank_before_filter(spark):
    m = log(spark, [(b"k", b"old", 0), (b"k", b"new", 5), (b"d", b"x", 0), (b"d", None, 0), (b"e", b"", 0), (b"n", b"v", -1)])
    assert state(snapshot.snapshot(m, 4)) == {b"k": b"new", b"e": b""}
    assert state(snapshot.snapshot(m, 5)) == {b"e": b""}  # at its expiry a key is gone, and what it hid stays hidden
    layers = m.withColumn("generation", F.col("seq"))
    assert state(runs.compact(layers, 5)) == {b"e": b""}
    assert snapshot.footprint(m).first() == (4, 1 + 3 + 1 + 1 + 2)


def test_key_order_is_unsigned(spark):
    m = log(spark, [(k, b"v", 0) for k in (b"\xff", b"\x7f", b"\x80", b"", b"\x00", b"a\x00", b"a")])
    got = [bytes(r.key) for r in snapshot.scan(m, b"", b"\xff\xff", 0).collect()]
    assert got == [b"", b"\x00", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff"]


def test_both_formulations_agree(spark):
    rnd = random.Random(3)
    m = log(spark, [(f"k{rnd.randrange(9)}".encode(), None if rnd.random() < 0.3 else b"v", 0) for _ in range(300)])
    assert set(snapshot.newest_wins(m).select("key", "seq").collect()) == set(snapshot.newest_wins_by_max(m).select("key", "seq").collect())


def test_lookup_filters_reach_the_scan(spark, tmp_path):
    log(spark, [(f"k{i}".encode(), b"v", 0) for i in range(100)]).write.parquet(str(tmp_path / "m"))
    plan = snapshot.get(spark.read.parquet(str(tmp_path / "m")), b"k7", 0)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def test_merge(spark):
    m = log(spark, [(b"k", b"old", 0), (b"keep", b"me", 0), (b"t", b"v", 0), (b"k", b"new", 0), (b"t", None, 0)]).withColumn("generation", F.when(F.col("seq") < 3, 9).otherwise(10))
    assert {bytes(r.key): r.value and bytes(r.value) for r in runs.merge(m).collect()} == {b"k": b"new", b"keep": b"me", b"t": None}
    assert state(runs.compact(m, 0)) == {b"k": b"new", b"keep": b"me"}
    assert runs.compact(m.filter("value is null"), 0).count() == 0


def test_sparse_index(spark, tmp_path):
    m = log(spark, [(f"key-{i:05d}".encode(), f"value-{i}".encode(), 0) for i in random.Random(1).sample(range(101), 101)])
    run_files.write(m, path := str(tmp_path / "run"), 3)
    sizes = [20 + 9 + len(f"value-{i}") for i in range(101)]
    got = {r.pos: (bytes(r.key).decode(), r.offset) for r in run_files.sparse_index(spark, path, MUTATION).collect()}
    assert got == {i: (f"key-{i:05d}", sum(sizes[:i])) for i in (0, 32, 64, 96)}


@pytest.mark.parametrize("rows", [10, 2_000_000])
def test_floor_search(spark, rows):
    index = spark.createDataFrame([(f"k{i:03d}", i) for i in range(0, 300, 3)], "key string, offset long")
    probes = [f"k{i:03d}" for i in range(-1, 305)] + ["a", "z"]
    got = {r.probe: r.floor_offset for r in runs.floor_search(index, spark.createDataFrame([(p,) for p in probes], "probe string"), rows).collect()}
    keys = {f"k{i:03d}": i for i in range(0, 300, 3)}
    assert got == {p: max((v for k, v in keys.items() if k <= p), default=None) for p in probes}


def test_floor_search_spreads_equal_probes(spark):
    index = spark.createDataFrame([("a", 1), ("m", 2)], "key string, offset long")
    found = runs.floor_search(index, spark.range(40_000).select(F.lit("k").alias("probe")), 40_002)
    assert found.groupBy("floor_key", "floor_offset").count().collect() == [("a", 1, 40_000)]
    assert found.select(F.spark_partition_id()).distinct().count() > 1


RECORDS = [(b"a", b"1", 0), (b"b", b"", 12345), (b"a", None, 0), (b"", b"\xff\x00", -7)]


def segment(spark, rows):
    df = log(spark, rows).withColumn("segment", F.lit(1))
    return bytes(wal.segment_bytes(df).first().content)


def test_codec_round_trip(spark):
    data = segment(spark, RECORDS)
    assert [x[1:] for x in codec.decode_bytes(data)] == RECORDS
    assert len(data) == sum(20 + len(k) + len(v or b"") for k, v, _ in RECORDS)


@pytest.mark.parametrize(("bend", "left"), [(lambda d: d[:-3], 3), (lambda d: d + bytes(range(1, 9)), 4), (lambda d: b"\x7f\xff\xff\xff", 0), (lambda d: d[:5] + b"x" + d[6:], 0), (lambda d: b"", 0), (lambda d: b"\xff\xff\xff\xff" + d, 0)])
def test_bad_tails_end_a_segment(spark, bend, left):
    assert len([*codec.decode_bytes(bend(segment(spark, RECORDS)))]) == left


def test_a_field_beyond_the_limit_is_refused(spark, monkeypatch):
    """A reader takes such a length for damage and drops what follows, so it must not be written."""
    monkeypatch.setattr(codec, "MAX_FIELD", 8)
    assert [x[1] for x in codec.decode_bytes(segment(spark, [(b"12345678", b"12345678", 0), (b"b", None, 0)]))] == [b"12345678", b"b"]
    for key, value in ((b"123456789", b""), (b"", b"123456789")):
        with pytest.raises(Exception, match="longer than 8 bytes"):
            segment(spark, [(b"a", b"1", 0), (key, value, 0), (b"b", b"2", 0)])


def test_replay_of_files(spark, tmp_path):
    assert wal.segments(spark, str(tmp_path / "none")).count() == 0
    for n, rows, cut in ((9, [(b"a", b"1", 0), (b"b", b"2", 0)], 3), (10, [(b"a", b"3", 0)], 0)):
        data = segment(spark, rows)
        (tmp_path / f"wal-{n}.log").write_bytes(data[: len(data) - cut])
    (tmp_path / "other.txt").write_bytes(b"x")
    found = wal.replay(wal.segments(spark, str(tmp_path)))
    assert state(snapshot.newest_wins(found)) == {b"a": b"3"}  # 10 is newer than 9; the cut record of 9 is lost, 10 still counts


def test_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"PING\r\nSET a b\r\r\n\nlast" + b"\n" + b"x" * ((1 << 20) + 1))
    got = [(r.line if len(r.line) < 99 else "long", r.too_long) for r in lines.read(spark, str(tmp_path / "in.txt")).collect()]
    assert got == [("PING", False), ("SET a b\r", False), ("", False), ("last", False), ("long", True)]


def test_lines_are_numbered_over_files(spark, tmp_path):
    for name, data in (("b", b"x\ny"), ("a", b"".join(b"SET k%d v\r\n" % i for i in range(5000))), ("c", b"")):
        (tmp_path / name).write_bytes(data)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # a file is read by many tasks
    try:
        got = sorted(tuple(r) for r in lines.numbered(lines.read(spark, str(tmp_path)), 7).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert got == [(i, 7, 0, f"SET k{i} v", False) for i in range(5000)] + [(5000, 7, 1, "x", False), (5001, 7, 1, "y", False)]


def test_generation_names(spark):
    df = spark.createDataFrame([("/x/wal-9.log",), ("wal-10.log",), ("wal-x.log",), ("wal-1.log.tmp",)], "p string")
    assert [r[0] for r in df.select(cells.generation(F.col("p"))).collect()] == [9, 10, None, None]


def test_utf8_repair(spark):
    assert spark.range(1).select(cells.utf8(F.lit(b"\xffA"))).first()[0] == "�A"


def test_nearest_rank(spark):
    df = spark.range(1, 11).select(F.col("id").alias("ns"))
    assert load_report.latency(df).first()[:] == (10, 5, 10, 10, 10)
    assert load_report.throughput(df, F.lit(2.0)).first()[:] == (10, 2.0, 5.0)


def test_report_in_milliseconds(spark):
    df = spark.range(1, 11).select((F.col("id") * 1_500_000).alias("ns"))
    assert load_report.report(df, F.lit(2.0)).first()[:] == (10, 2.0, 5.0, 7.5, 15.0, 15.0, 15.0)


def test_workload(spark):
    a, b = (workload.generate(spark, 3, 100, 30).collect() for _ in range(2))
    assert a == b and len(a) == 300 and 40 < sum(r.line.startswith("SET") for r in a) < 140


# --------------------------------------------------------------------------- store
def test_store_against_the_model(spark, tmp_path):
    rnd, model, clock = random.Random(5), Model(), [0]
    store = Store(spark, str(tmp_path / "s"), flush_bytes=120, trigger=3, clock=lambda: clock[0])
    seq = 0
    for _ in range(9):
        batch = []
        for _ in range(15):
            key, kind = f"k{rnd.randrange(8)}".encode(), rnd.random()
            value, expiry = (None, 0) if kind < 0.3 else (f"v{seq}".encode(), clock[0] + 2000 if kind < 0.5 else 0)
            model.put(key, value, expiry)
            batch.append((seq, key, value, expiry))
            seq += 1
        store.append(spark.createDataFrame(batch, MUTATION))
        clock[0] += 700
        assert state(store.snapshot()) == model.snapshot(clock[0])
    store.flush()
    assert state(Store(spark, store.base, clock=store.clock).snapshot()) == model.snapshot(clock[0])


def test_store_verbs_and_recovery(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 10)
    assert store.get(b"a") is None and store.delete(b"a") is False
    store.put(b"a", b"1")
    store.put(b"b", b"2", expiry_ms=10)
    assert (store.get(b"a"), store.get(b"b"), store.delete(b"b"), store.delete(b"a"), store.get(b"a")) == (b"1", None, False, True, None)
    store.put(b"c", b"3")
    assert state(Store(spark, store.base, clock=store.clock).scan(b"a", b"z")) == {b"c": b"3"}


def test_flush_keeps_tombstones_and_compaction_drops_them(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), flush_bytes=1 << 30, trigger=2, clock=lambda: 0)
    store.put(b"k", b"v")
    store.flush()
    assert not store.compact_if_due()
    store.delete(b"k")
    pinned = store.manifest()
    store.flush()  # second run: compaction is due
    assert store.log().count() == 0 and len(store.manifest().runs) == 1
    assert store.log(pinned).count() == 2  # a reader of the older manifest still reads what it pinned
    stray = tmp_path / "s" / "runs" / "run-stray"
    stray.mkdir()
    gone = store.vacuum()
    assert "runs/run-stray" in gone and not stray.exists() and store.snapshot().count() == 0


def test_second_writer_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 0)
    store.put(b"a", b"1")
    old = store.manifest()
    store.put(b"b", b"2")
    with pytest.raises(RuntimeError):
        store._commit(old, runs=())


def test_a_writer_in_between_is_noticed(spark, tmp_path, monkeypatch):
    """A sequence number is taken from one manifest and committed against it, so it is never given twice."""
    first, second = (Store(spark, str(tmp_path / "s"), clock=lambda: 0) for _ in range(2))
    first.put(b"k", b"0")
    write = Store.append

    def interrupted(self, batch, batch_id=None, at=None):
        monkeypatch.setattr(Store, "append", write)
        second.put(b"k", b"theirs")
        write(self, batch, batch_id, at)

    monkeypatch.setattr(Store, "append", interrupted)
    with pytest.raises(Conflict):
        first.put(b"k", b"ours")
    monkeypatch.setattr(Store, "append", interrupted)
    with pytest.raises(Conflict):
        first.delete(b"k")
    seqs = [r.seq for r in first.log().collect()]
    assert len(seqs) == len(set(seqs)) == 3 and state(first.snapshot()) == {b"k": b"theirs"}


@pytest.mark.parametrize("step", ["flush", "compact"])
def test_flush_and_compaction_keep_what_others_add_meanwhile(spark, tmp_path, monkeypatch, step):
    store, other = (Store(spark, str(tmp_path / "s"), flush_bytes=1 << 30, trigger=99, clock=lambda: 0) for _ in range(2))
    for value in (b"1", None):
        store.put(b"k", value) if value else store.delete(b"k")
        store.put(b"x", b"x")
        if step == "compact":
            store.flush()
    write = run_files.write

    def interrupted(df, path, *rest):
        write(df, path, *rest)
        monkeypatch.setattr(run_files, "write", write)
        other.put(b"new", b"n")
        if step == "compact":
            other.flush()

    monkeypatch.setattr(run_files, "write", interrupted)
    getattr(store, step)()
    now = store.manifest()
    assert state(store.snapshot()) == {b"x": b"x", b"new": b"n"}
    assert (len(now.segments), len(now.runs)) == ((1, 1) if step == "flush" else (0, 2))
    if step == "compact":
        assert store.log().count() == 2  # the tombstone went, as the oldest run took part
    store.vacuum()
    assert state(store.snapshot()) == {b"x": b"x", b"new": b"n"}


def test_a_compaction_without_the_oldest_run_keeps_tombstones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), flush_bytes=1 << 30, trigger=99, clock=lambda: 5)
    for change in (lambda: store.put(b"k", b"old"), lambda: store.delete(b"k"), lambda: store.put(b"e", b"v", 5)):
        change()
        store.flush()
    store.compact(newest=2)
    assert len(store.manifest().runs) == 2 and store.log().count() == 3 and state(store.snapshot()) == {}
    store.compact()
    assert len(store.manifest().runs) == 1 and store.log().count() == 0 and set(store.manifest().sizes) == set(store.manifest().runs)


def test_what_is_pinned_outlives_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), flush_bytes=1 << 30, clock=lambda: 0)
    store.put(b"k", b"1")
    with store.pin() as then:
        store.put(b"k", b"2")
        store.flush()
        assert len(store.vacuum()) == 1  # the segment of the second put
        assert state(snapshot.snapshot(store.log(then), 0)) == {b"k": b"1"} and state(store.snapshot()) == {b"k": b"2"}
    assert len(store.vacuum()) == 1 and state(store.snapshot()) == {b"k": b"2"}


def test_tiers_rewrite_little():
    """Bytes written by flushes and compactions for each byte flushed, over 4000 flushes (16 GB of memtables of 4 MiB)."""

    def amplification(pick, flushes):
        sizes, written = [], 0
        for _ in range(flushes):
            sizes.insert(0, 1)
            written += 1
            if n := pick(sizes):
                sizes[:n] = [sum(sizes[:n])]
                written += sizes[0]
        return written / flushes, len(sizes)

    tiers, runs_left = amplification(tier, 4000)
    assert tiers < 20 and runs_left < 16
    assert amplification(lambda s: len(s) if len(s) >= 4 else 0, 4000)[0] > 600  # all runs each time
    assert tier([1]) == tier([1, 1, 1]) == tier([1, 9, 99, 999]) == 0 and tier([1, 1, 1, 1]) == 4 and tier([1, 1, 1, 99]) == 3


def test_overwrites_do_not_flush(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), flush_bytes=30, clock=lambda: 0)
    for i in range(5):
        store.put(b"k", b"%010d" % i)  # 11 bytes: the log passes the threshold, the memtable does not
    now = store.manifest()
    assert not now.runs and len(now.segments) <= 3 and now.open_most < 33 and state(store.snapshot()) == {b"k": b"0000000004"}
    store.put(b"l", b"x" * 30)
    assert len(store.manifest().runs) == 1 and not store.manifest().segments and store.manifest().open_most == 0


def test_stream_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 0)
    batch = log(spark, [(b"a", b"1", 0)])
    store.append(batch, 4)
    store.append(log(spark, [(b"a", b"other", 0)]), 4)
    assert state(store.snapshot()) == {b"a": b"1"}


def test_stream_into_store_and_live_view(spark, tmp_path):
    log(spark, [(b"a", b"1", 0), (b"b", b"2", 0), (b"a", None, 0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(MUTATION).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 0)
    ingest.into(stream(), store, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert state(store.snapshot()) == {b"b": b"2"}
    q = ingest.newest(stream()).writeStream.outputMode("complete").format("memory").queryName("live_view").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(bytes(r.key), r.seq) for r in spark.table("live_view").collect()} == {(b"a", 2), (b"b", 1)}


# --------------------------------------------------------------------------- exchange with binary files
def test_run_file(spark):
    m = log(spark, [(f"key-{i:05d}".encode(), None if i == 7 else f"value-{i}".encode(), i) for i in range(101)])
    (one,) = run_bytes.encoded(m, 1).collect()
    content = bytes(one.content)
    assert [r[1:] for r in run_bytes.records(content)] == [(f"key-{i:05d}".encode(), None if i == 7 else f"value-{i}".encode(), i) for i in range(101)]
    entries = run_bytes.index(content)
    assert [k for k, _ in entries] == [f"key-{i:05d}".encode() for i in (0, 32, 64, 96)]
    assert all(content[at + 4 : at + 4 + len(k)] == k for k, at in entries)
    assert [*run_bytes.records(run_bytes.join([]))] == []
    for bad in (content[:-1], content[:40] + b"!" + content[41:], b""):
        with pytest.raises(ValueError):
            [*run_bytes.records(bad)]


def test_point_lookup_in_run_files(spark):
    old = log(spark, [(f"key-{i:05d}".encode(), b"old", 0) for i in range(0, 200, 2)])
    new = log(spark, [(f"key-{i:05d}".encode(), None if i % 3 else b"new", i) for i in range(0, 200, 5)])
    files = [(n, bytes(r.content)) for n, df in ((9, old), (10, new)) for r in run_bytes.encoded(df, 1).collect()]
    for key in [f"key-{i:05d}".encode() for i in range(-1, 201)] + [b"", b"z"]:
        for _, content in files:
            assert run_bytes.find(content, key) == next(((v, e) for _, k, v, e in run_bytes.records(content) if k == key), None)
    assert run_bytes.find(run_bytes.join([]), b"a") is None
    asked = [b"key-00000", b"key-00002", b"key-00005", b"key-00007", b"key-00015"]
    got = {bytes(r.key): (r.generation, r.value and bytes(r.value), r.expiry_ms) for r in run_bytes.lookup(spark.createDataFrame(files, "generation int, content binary"), asked).collect()}
    assert got == {b"key-00000": (10, b"new", 0), b"key-00002": (9, b"old", 0), b"key-00005": (10, None, 5), b"key-00015": (10, b"new", 15)}
    assert run_bytes.files_for(old, 100) == 32


def test_take_over_a_folder(spark, tmp_path):
    def write(name, rows):
        (one,) = run_bytes.encoded(log(spark, rows), 1).collect()
        (tmp_path / name).write_bytes(bytes(one.content))

    write("sstable-9.sst", [(b"a", b"1", 0), (b"b", b"1", 0), (b"c", b"1", 0)])
    write("sstable-10.sst", [(b"b", b"2", 0), (b"c", None, 0)])
    (tmp_path / "sstable-99.sst.tmp").write_bytes(b"left over")
    data = segment(spark, [(b"d", b"1", 0), (b"a", b"3", 50), (b"d", None, 0)])
    (tmp_path / "wal-3.log").write_bytes(data[:-1])
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 49)
    store.recover(str(tmp_path))
    assert state(store.snapshot()) == {b"a": b"3", b"b": b"2", b"d": b"1"}


def test_consolidation(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 0)
    for v in (b"1", b"2", None, b"3"):
        store.append(log(spark, [(b"k", v, 0)]).withColumn("seq", F.lit(store.manifest().next_seq)))
    store.consolidate()
    store.vacuum()
    assert len(store.manifest().segments) == 1 and store.log().count() == 1 and state(store.snapshot()) == {b"k": b"3"}
