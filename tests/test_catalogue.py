"""Every query with SQL gives DuckDB's rows; the others are compared with Python."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("events", "customer", "orders", "lineitem", "region"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted((tuple(map(repr, r)) for r in found))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.collect()) == rows(expected.select(*[f'"{c}"' for c in got.columns]).fetchall())


def test_checksums(spark, duck):
    import struct
    import zlib

    got = dict(catalogue.QUERIES["kv_record_crc"](spark, SF).collect())
    for seq, key, value, expiry in catalogue.QUERIES["kv_mutation_log"](spark, SF).select("seq", "key", "value", "expiry_ms").collect():
        data = struct.pack(">i", len(key)) + key.encode() + struct.pack(">q", expiry) + (struct.pack(">i", -1) if value is None else struct.pack(">i", len(value)) + value.encode())
        assert got[seq] == struct.unpack(">i", struct.pack(">I", zlib.crc32(data)))[0]


def test_flush_boundaries(spark, duck):
    from model import flushes

    log = [(r.key, r.value) for r in catalogue.QUERIES["kv_mutation_log"](spark, SF).orderBy("seq").collect()]
    for threshold in (1000, 60):
        from palimpsest.operators.flush import boundaries

        got = sorted(boundaries(catalogue.QUERIES["kv_mutation_log"](spark, SF), threshold).collect(), key=lambda r: (r.flush is None, r.flush))
        expected, rest = flushes(log, threshold)
        assert [(r.last_seq, r.n_keys, r.n_bytes) for r in got if r.flush is not None] == expected
        assert [(r.n_keys, r.n_bytes) for r in got if r.flush is None] == ([rest] if rest[0] else [])


def test_golden_numbers(spark, duck):
    count = lambda name: catalogue.QUERIES[name](spark, SF).count()
    assert (count("kv_mutation_log"), count("kv_newest_wins"), count("kv_live_snapshot"), count("kv_tombstones"), count("kv_expired")) == (1000, 15, 12, 3, 0)
    existed = catalogue.QUERIES["kv_delete_existed"](spark, SF)
    assert (existed.count(), existed.filter("existed").count()) == (201, 140)
    histogram = dict(catalogue.QUERIES["kv_response_histogram"](spark, SF).collect())
    assert histogram == {"+OK": 396, "+PONG": 11, "$": 239, "$-1": 155, ":1": 117, ":0": 82}
    assert count("kv_sparse_index") == 47


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if Path(SF).exists():
        assert __spark_entry__.entry(spark).count() == 1000
