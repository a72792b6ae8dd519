"""The queries of the store over the event table, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import cells, codec
from palimpsest.operators import commands, flush, load_report, runs, snapshot
from palimpsest.plans import serve
from palimpsest.plans.shared import new_path
from palimpsest.plans.store import Store
from palimpsest.sources import events, run_bytes, wal
from palimpsest.sources import runs as run_files
from palimpsest.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --------------------------------------------------------------------------- shared SQL
_M = """
m AS (
  SELECT event_id AS seq, 'user:' || user_id AS key, CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) END AS value,
         CASE WHEN event_type = 'error' OR k = 0 THEN 0 ELSE ts_ms + k * 3600000 END AS expiry_ms, ts_ms
  FROM (SELECT *, epoch_us(ts) // 1000 AS ts_ms, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
), clock AS (SELECT max(ts_ms) AS now_ms FROM m
), newest AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
), live AS (SELECT newest.* FROM newest, clock WHERE value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= now_ms)
), runs AS (
  SELECT *, CAST(seq // 250 AS INTEGER) AS generation FROM m
  QUALIFY row_number() OVER (PARTITION BY seq // 250, key ORDER BY seq DESC) = 1
), winners AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC) = 1)
"""
_CL = """
cl AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id % 8 AS conn, user_id, event_type, CAST(value AS VARCHAR) AS v,
         CAST(props->>'$.k' AS BIGINT) AS k,
         CASE WHEN event_id % 97 = 0 THEN 'PING' WHEN event_type IN ('signup', 'purchase') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS verb
  FROM events
), cmd AS (
  SELECT seq, ts_ms, conn, verb, CASE WHEN verb <> 'PING' THEN 'user:' || user_id END AS key, CASE WHEN verb = 'SET' THEN v END AS value,
         CASE WHEN verb = 'SET' THEN CASE WHEN event_type = 'purchase' THEN k * 3600 ELSE 0 END END AS ttl_s
  FROM cl
), seen AS (
  SELECT *, lag(st IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS prev
  FROM (SELECT *, CASE WHEN verb IN ('SET', 'DEL') THEN {'value': value, 'expiry': CASE WHEN ttl_s > 0 THEN ts_ms + ttl_s * 1000 ELSE 0 END} END AS st FROM cmd)
), answered AS (
  SELECT seq, conn, verb, key, hit,
         CASE verb WHEN 'PING' THEN '+PONG' WHEN 'SET' THEN '+OK' WHEN 'GET' THEN '$' || CASE WHEN hit THEN prev.value ELSE '-1' END ELSE ':' || CASE WHEN hit THEN 1 ELSE 0 END END AS response
  FROM (SELECT *, CASE WHEN verb IN ('GET', 'DEL') THEN coalesce(prev.value IS NOT NULL AND NOT (prev.expiry <> 0 AND prev.expiry <= ts_ms), false) END AS hit FROM seen)
)
"""


def query(sql: str | None = None, log: bool = True, name: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = f"WITH {_M if log else _CL} {sql}"
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.mutations(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _now(log: DataFrame) -> Column:
    """The time of the last mutation, as a scalar subquery."""
    return log.agg(F.max("ts_ms")).scalar()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.command_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


# --------------------------------------------------------------------------- state
@query("SELECT seq, key, value, expiry_ms, ts_ms FROM m")
def kv_mutation_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query("SELECT key, seq, value, expiry_ms FROM newest")
def kv_newest_wins(spark, sf_dir):
    return snapshot.newest_wins(_log(spark, sf_dir)).select("key", "seq", "value", "expiry_ms")


@query("SELECT key, seq, value, expiry_ms FROM newest")
def kv_newest_wins_maxby(spark, sf_dir):
    return snapshot.newest_wins_by_max(_log(spark, sf_dir))


@query("SELECT key, value, expiry_ms FROM live")
def kv_live_snapshot(spark, sf_dir):
    log = _log(spark, sf_dir)
    return snapshot.snapshot(log, _now(log)).select("key", "value", "expiry_ms")


@query("""
SELECT key, seq, value FROM (
  SELECT * FROM m WHERE seq <= (SELECT max(seq) // 2 FROM m) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
) WHERE value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= (SELECT max(ts_ms) FROM m WHERE seq <= (SELECT max(seq) // 2 FROM m)))""")
def kv_snapshot_asof(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = log.agg(F.max("seq")).first()[0] // 2
    return snapshot.as_of(log, half, _now(log.filter(F.col("seq") <= half))).select("key", "seq", "value")


@query("SELECT key, seq FROM newest WHERE value IS NULL")
def kv_tombstones(spark, sf_dir):
    return snapshot.tombstones(snapshot.newest_wins(_log(spark, sf_dir))).select("key", "seq")


@query("SELECT key, seq, expiry_ms FROM newest, clock WHERE value IS NOT NULL AND expiry_ms <> 0 AND expiry_ms <= now_ms")
def kv_expired(spark, sf_dir):
    log = _log(spark, sf_dir)
    return snapshot.expired(snapshot.newest_wins(log), _now(log)).select("key", "seq", "expiry_ms")


def _get(which: str | None) -> Query:
    """GET of the smallest key whose newest version is as asked; without one (or for None) of a key that was never written."""

    def run(spark, sf_dir):
        log = _log(spark, sf_dir)
        newest = snapshot.newest_wins(log)
        kinds = {"live": snapshot.live(newest, _now(log)), "tombstone": snapshot.tombstones(newest), "expired": snapshot.expired(newest, _now(log))}
        key = (kinds[which].agg(F.min("key")).first()[0] if which else None) or "user:none"
        return snapshot.get(log, key, _now(log))

    return run


for _name, _kind, _where in (
    ("kv_get_hit", "live", "value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= now_ms)"), ("kv_get_miss_tombstone", "tombstone", "value IS NULL"),
    ("kv_get_miss_expired", "expired", "value IS NOT NULL AND expiry_ms <> 0 AND expiry_ms <= now_ms"), ("kv_get_absent", None, "false"),
):
    query(f"SELECT a.key, live.key IS NOT NULL AS hit, live.value FROM (SELECT coalesce(min(key), 'user:none') AS key FROM newest, clock WHERE {_where}) a LEFT JOIN live USING (key)", name=_name)(_get(_kind))


@query("SELECT a.key, live.key IS NOT NULL AS hit, live.value FROM (SELECT 'user:' || c_custkey AS key FROM customer) a LEFT JOIN live USING (key)")
def kv_multi_get(spark, sf_dir):
    log = _log(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("asked"))
    return snapshot.multi_get(log, asked, _now(log))


@query("SELECT a.key, live.key IS NOT NULL AS hit, live.value FROM (SELECT 'user:' || o_custkey AS key FROM orders) a LEFT JOIN live USING (key)")
def kv_multi_get_orders(spark, sf_dir):
    """A lookup for each order: ten times as many as customers, many of the same keys."""
    log = _log(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("asked"))
    return snapshot.multi_get(log, asked, _now(log))


@query("SELECT key, value FROM live WHERE key >= 'user:1' AND key < 'user:5'")
def kv_range_scan(spark, sf_dir):
    log = _log(spark, sf_dir)
    return snapshot.scan(log, "user:1", "user:5", _now(log)).select("key", "value")


@query("SELECT seq, key, coalesce(p.value IS NOT NULL AND NOT (p.expiry <> 0 AND p.expiry <= ts_ms), false) AS existed FROM (SELECT *, lag({'value': value, 'expiry': expiry_ms}) OVER (PARTITION BY key ORDER BY seq) AS p FROM m) WHERE value IS NULL")
def kv_delete_existed(spark, sf_dir):
    return commands.deletes(_log(spark, sf_dir))


@query("SELECT seq, key, NOT (expiry_ms <> 0 AND expiry_ms <= expiry_ms) AS live_at, NOT (expiry_ms <> 0 AND expiry_ms <= expiry_ms - 1) AS live_before FROM m WHERE value IS NOT NULL AND expiry_ms <> 0")
def kv_ttl_boundary(spark, sf_dir):
    sets = _log(spark, sf_dir).filter("value is not null and expiry_ms <> 0")
    at = lambda now: cells.is_live(F.col("value"), F.col("expiry_ms"), now)
    return sets.select("seq", "key", at(F.col("expiry_ms")).alias("live_at"), at(F.col("expiry_ms") - 1).alias("live_before"))


@query("SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM newest")
def kv_key_order(spark, sf_dir):
    newest = snapshot.newest_wins(_log(spark, sf_dir)).select("key", "value")
    run_files.write(newest, path := new_path(spark, "run"))
    return run_files.positions(spark, path, newest.schema).select("key", "pos")


@query("SELECT count(DISTINCT key) AS n_keys FROM m")
def kv_memtable_cardinality(spark, sf_dir):
    return snapshot.footprint(_log(spark, sf_dir)).select("n_keys")


@query("SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS n_bytes FROM newest")
def kv_memtable_bytes(spark, sf_dir):
    return snapshot.footprint(_log(spark, sf_dir)).select("n_bytes")


# --------------------------------------------------------------------------- runs
@query("SELECT generation, key, seq, value, expiry_ms FROM runs")
def kv_run_newest(spark, sf_dir):
    return events.runs(_log(spark, sf_dir)).select("generation", "key", "seq", "value", "expiry_ms")


@query("""
SELECT key, layer, CASE WHEN value IS NULL THEN 'tombstone' WHEN expiry_ms <> 0 AND expiry_ms <= now_ms THEN 'expired' ELSE 'live' END AS state,
       CASE WHEN value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= now_ms) THEN value END AS value
FROM (SELECT key, generation AS layer, value, expiry_ms FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC) = 1), clock""")
def kv_layered_lookup(spark, sf_dir):
    """The last generation is the open memtable, the others are runs."""
    log = _log(spark, sf_dir)
    layers = events.runs(log).withColumnRenamed("generation", "layer")
    return runs.layered_lookup(layers, _now(log))


@query("SELECT key, generation, value, expiry_ms FROM winners")
def kv_merge_runs(spark, sf_dir):
    return runs.merge(events.runs(_log(spark, sf_dir))).select("key", "generation", "value", "expiry_ms")


@query("SELECT key, generation, value, expiry_ms FROM winners, clock WHERE value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= now_ms)")
def kv_compact(spark, sf_dir):
    log = _log(spark, sf_dir)
    return runs.compact(events.runs(log), _now(log)).select("key", "generation", "value", "expiry_ms")


@query("""
SELECT (SELECT count(*) FROM runs) AS n_in, (SELECT count(*) FROM runs) - count(*) AS n_superseded, count(*) FILTER (value IS NULL) AS n_tombstones,
       count(*) FILTER (value IS NOT NULL AND expiry_ms <> 0 AND expiry_ms <= now_ms) AS n_expired,
       count(*) FILTER (value IS NOT NULL AND NOT (expiry_ms <> 0 AND expiry_ms <= now_ms)) AS n_out
FROM winners, clock""")
def kv_compaction_stats(spark, sf_dir):
    log = _log(spark, sf_dir)
    return runs.compaction_stats(events.runs(log), _now(log))


_ORDERS = "orders_run AS (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\", value FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value, 20 + strlen(CAST(o_orderkey AS VARCHAR)) + coalesce(strlen(o_orderstatus), 0) AS size FROM orders))"


def _orders_run(spark: SparkSession, sf_dir: str):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cells_ = orders.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    run_files.write(cells_, path := new_path(spark, "run"))
    return path, cells_.schema


@query()
def kv_sparse_index(spark, sf_dir):
    return run_files.sparse_index(spark, *_orders_run(spark, sf_dir))


ORACLE["kv_sparse_index"] = f'WITH {_ORDERS} SELECT pos, key, CAST("offset" AS BIGINT) AS "offset" FROM orders_run WHERE pos % 32 = 0'


@query()
def kv_run_offsets(spark, sf_dir):
    return run_files.positions(spark, *_orders_run(spark, sf_dir)).select("key", "offset")


ORACLE["kv_run_offsets"] = f'WITH {_ORDERS} SELECT key, CAST("offset" AS BIGINT) AS "offset" FROM orders_run'


def _orders_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_files.read(spark, *_orders_run(spark, sf_dir)).withColumn("expiry_ms", F.lit(0).cast("long"))
    return run_bytes.encoded(run, run_bytes.files_for(run, 1 << 20))


@query()
def kv_run_file_roundtrip(spark, sf_dir):
    """The orders' run is written as binary files with index and footer, and read again."""
    back = run_bytes.decoded(_orders_files(spark, sf_dir))
    return back.select(cells.utf8(F.col("key")).alias("key"), cells.utf8(F.col("value")).alias("value"), "expiry_ms")


ORACLE["kv_run_file_roundtrip"] = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value, CAST(0 AS BIGINT) AS expiry_ms FROM orders"


@query()
def kv_run_get(spark, sf_dir):
    """The five region keys are looked for in the binary files of the orders' run alone, by the sparse index of each."""
    keys = [str(r[0]).encode() for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]
    found = run_bytes.lookup(_orders_files(spark, sf_dir), keys)
    return found.select(cells.utf8(F.col("key")).alias("key"), cells.utf8(F.col("value")).alias("value"), "expiry_ms")


ORACLE["kv_run_get"] = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value, CAST(0 AS BIGINT) AS expiry_ms FROM orders JOIN region ON o_orderkey = r_regionkey"


@query()
def kv_index_floor(spark, sf_dir):
    """Every order key of the line items is looked for, with a suffix that no key has."""
    path, schema = _orders_run(spark, sf_dir)
    index = run_files.sparse_index(spark, path, schema)
    probes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("probe"))
    return runs.floor_search(index, probes, rows=run_files.read(spark, path, schema).count())


ORACLE["kv_index_floor"] = f"""WITH {_ORDERS}, idx AS (SELECT key, CAST("offset" AS BIGINT) AS "offset" FROM orders_run WHERE pos % 32 = 0)
SELECT probe, idx.key AS floor_key, idx."offset" AS floor_offset
FROM (SELECT l_orderkey || '.' || l_linenumber AS probe FROM lineitem) p ASOF LEFT JOIN idx ON p.probe >= idx.key"""


# --------------------------------------------------------------------------- log records
@query("SELECT seq, CAST(20 + strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS size FROM m")
def kv_record_size(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", cells.record_size(F.col("key"), F.col("value")).alias("size"))


@query("""
SELECT seq, printf('%08X', strlen(key)) || hex(encode(key)) || printf('%016X', expiry_ms) || CASE WHEN value IS NULL THEN 'FFFFFFFF' ELSE printf('%08X', strlen(value)) || hex(encode(value)) END AS body
FROM m""")
def kv_record_body(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", F.hex(codec.body(F.col("key"), F.col("value"), F.col("expiry_ms"))).alias("body"))


@query("""
, steps AS (  -- eight shifts of each byte value
  SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)
), body AS (
  SELECT seq, printf('%08X', strlen(key)) || hex(encode(key)) || printf('%016X', expiry_ms) || CASE WHEN value IS NULL THEN 'FFFFFFFF' ELSE printf('%08X', strlen(value)) || hex(encode(value)) END AS x FROM m
), bytes AS (
  SELECT seq, list_transform(range(0, CAST(strlen(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM body
), sums AS (
  SELECT seq, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS BIGINT) + 1])), 4294967295) AS c FROM bytes, steps
) SELECT seq, CAST(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END AS INTEGER) AS crc FROM sums""")
def kv_record_crc(spark, sf_dir):
    """DuckDB has no CRC-32, so its SQL sums the bytes by table; tests compare with Python's as well."""
    data = codec.body(F.col("key"), F.col("value"), F.col("expiry_ms"))
    return _log(spark, sf_dir).select("seq", codec.signed_crc32(data).alias("crc"))


def _segmented(log: DataFrame) -> DataFrame:
    return log.withColumn("segment", F.floor(F.col("seq") / events.SEGMENT).cast("int"))


@query("SELECT CAST(seq // 250 AS INTEGER) AS segment, row_number() OVER (PARTITION BY seq // 250 ORDER BY seq) - 1 AS pos, key, value, expiry_ms FROM m")
def kv_wal_decode(spark, sf_dir):
    """The log is encoded into segments of bytes and decoded again."""
    back = codec.decode(wal.segment_bytes(_segmented(_log(spark, sf_dir))))
    return back.select("segment", "pos", cells.utf8(F.col("key")).alias("key"), cells.utf8(F.col("value")).alias("value"), "expiry_ms")


@query("""
, faults AS (SELECT seq // 250 AS segment, min(seq % 250) AS bad FROM m WHERE seq % 83 = 82 GROUP BY 1)
SELECT key, seq, value, expiry_ms FROM (
  SELECT m.* FROM m LEFT JOIN faults f ON m.seq // 250 = f.segment WHERE bad IS NULL OR m.seq % 250 < bad
) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""")
def kv_wal_replay_prefix(spark, sf_dir):
    """Every 83rd record is taken as damaged: each segment counts up to its first damaged record, later segments still count."""
    log = _segmented(_log(spark, sf_dir)).withColumn("pos", F.col("seq") % events.SEGMENT).withColumn("ok", F.col("seq") % 83 != 82)
    return snapshot.newest_wins(wal.valid_prefix(log, "segment", "pos", "ok")).select("key", "seq", "value", "expiry_ms")


@query()
def kv_wal_crc_replay(spark, sf_dir):
    """The same with bytes: in every segment whose number is odd the last byte is cut off, so its last record is lost."""
    found = wal.segment_bytes(_segmented(_log(spark, sf_dir)))
    cut = found.withColumn("content", F.when(F.col("segment") % 2 == 1, F.substring("content", F.lit(1), F.octet_length("content") - 1)).otherwise(F.col("content")))
    newest = snapshot.newest_wins(wal.replay(cut))
    return newest.select(cells.utf8(F.col("key")).alias("key"), "segment", "pos", cells.utf8(F.col("value")).alias("value"), "expiry_ms")


ORACLE["kv_wal_crc_replay"] = f"""WITH {_M}, r AS (
  SELECT *, CAST(seq // 250 AS INTEGER) AS segment, row_number() OVER (PARTITION BY seq // 250 ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY seq // 250) AS n FROM m
) SELECT key, segment, pos, value, expiry_ms FROM r WHERE segment % 2 = 0 OR pos < n - 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""


@query("SELECT name, generation, row_number() OVER (ORDER BY generation) - 1 AS place FROM (SELECT DISTINCT 'wal-' || seq // 250 || '.log' AS name, CAST(seq // 250 AS INTEGER) AS generation FROM m)")
def kv_generation_order(spark, sf_dir):
    from pyspark.sql import Window

    names = _segmented(_log(spark, sf_dir)).select(F.concat(F.lit("wal-"), F.col("segment").cast("string"), F.lit(".log")).alias("name")).distinct()
    numbered = names.withColumn("generation", cells.generation(F.col("name")))
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("generation")) - 1)  # one row per segment file


@query()
def kv_flush_boundaries(spark, sf_dir):
    """Memtables of a thousand bytes."""
    return flush.boundaries(_log(spark, sf_dir), threshold=1000)


ORACLE["kv_flush_boundaries"] = f"""WITH RECURSIVE {_M}, r AS (
  SELECT row_number() OVER (ORDER BY seq) AS i, seq, key, strlen(key) + coalesce(strlen(value), 0) AS size FROM m
), walk(i, seq, sizes, total, done, closed) AS (  -- one mutation a step; a closed memtable is followed by an empty one
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), MAP {{}}::MAP(VARCHAR, BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL
  SELECT i, seq, sizes, list_sum(map_values(sizes)), done, list_sum(map_values(sizes)) >= 1000
  FROM (
    SELECT r.i, r.seq, map_concat(CASE WHEN closed THEN MAP {{}}::MAP(VARCHAR, BIGINT) ELSE sizes END, MAP {{r.key: CAST(r.size AS BIGINT)}}) AS sizes, done + CASE WHEN closed THEN 1 ELSE 0 END AS done
    FROM walk JOIN r ON r.i = walk.i + 1
  )
)
SELECT CASE WHEN closed THEN done END AS flush, seq AS last_seq, CAST(cardinality(sizes) AS BIGINT) AS n_keys, CAST(total AS BIGINT) AS n_bytes
FROM walk WHERE closed OR i > 0 AND i = (SELECT max(i) FROM r)"""


# --------------------------------------------------------------------------- commands
@query("SELECT seq, verb, key, value, ttl_s, CAST(NULL AS VARCHAR) AS error FROM cmd", log=False)
def kv_parse_commands(spark, sf_dir):
    return commands.parsed(_lines(spark, sf_dir)).select("seq", "verb", "key", "value", "ttl_s", "error")


def _bent(lines: DataFrame) -> DataFrame:
    """Lines that are bent in eight ways, by their number."""
    line, way = F.col("line"), F.col("seq") % 8
    bent = (
        F.when(way == 0, F.concat(F.lit("  "), F.lower(line), F.lit("\t ")))
        .when(way == 1, F.regexp_extract(line, r"^\S+", 0))
        .when(way == 2, F.regexp_replace(line, " ", "  "))
        .when(way == 3, F.concat(line, F.lit(" EX 5")))
        .when(way == 4, F.concat(line, F.lit(" EX 99999999999999999999")))
        .when(way == 5, F.concat(F.lit("X"), line))
        .when(way == 6, F.concat(line, F.lit(" tail  ex 7")))
        .otherwise(F.lit(" "))
    )
    return lines.withColumn("line", bent)


_BENT = """
, bent AS (
  SELECT seq, seq % 8 AS way, verb AS v0, key AS k0, v, event_type,
         CASE WHEN verb <> 'SET' THEN NULL WHEN event_type = 'purchase' THEN ' EX ' || k * 3600 ELSE '' END AS ex, k
  FROM (SELECT *, CASE WHEN verb <> 'PING' THEN 'user:' || user_id END AS key FROM cl)
), out AS (
  SELECT seq, CASE way WHEN 5 THEN 'X' || v0 ELSE v0 END AS verb,
    CASE WHEN way = 5 THEN 'unknown command ''X' || v0 || ''''
         WHEN v0 = 'PING' THEN NULL
         WHEN way = 1 THEN 'wrong number of arguments for ''' || v0 || ''''
         WHEN v0 IN ('GET', 'DEL') THEN CASE WHEN way IN (3, 4, 6) THEN 'wrong number of arguments for ''' || v0 || '''' END
         WHEN way = 4 THEN 'invalid EX value' END AS error,
    CASE WHEN v0 = 'SET' THEN CASE way
      WHEN 0 THEN v || CASE WHEN event_type = 'purchase' THEN ' ex ' || k * 3600 ELSE '' END
      WHEN 2 THEN ' ' || v || CASE WHEN event_type = 'purchase' THEN ' ' ELSE '' END
      WHEN 3 THEN v || ex
      WHEN 6 THEN v || ex || ' tail  ex 7' END END AS value,
    CASE WHEN v0 = 'SET' THEN CASE way WHEN 2 THEN CASE WHEN event_type = 'purchase' THEN k * 3600 ELSE 0 END WHEN 3 THEN 5 ELSE 0 END END AS ttl_s,
    k0, way
  FROM bent WHERE way <> 7
)
"""


@query(f"{_BENT} SELECT seq, verb, error FROM out", log=False)
def kv_parse_errors(spark, sf_dir):
    return commands.parsed(_bent(_lines(spark, sf_dir))).select("seq", "verb", "error")


@query(f"{_BENT} SELECT seq, k0 AS key, value, CAST(ttl_s AS BIGINT) AS ttl_s FROM out WHERE verb = 'SET' AND error IS NULL", log=False)
def kv_parse_ttl(spark, sf_dir):
    return commands.parsed(_bent(_lines(spark, sf_dir))).filter("verb = 'SET' and error is null").select("seq", "key", "value", "ttl_s")


@query("SELECT seq, verb, key, response, hit FROM answered", log=False)
def kv_command_responses(spark, sf_dir):
    return commands.evaluate(commands.parsed(_lines(spark, sf_dir)))


@query("SELECT CASE WHEN response LIKE '$%' THEN CASE WHEN hit THEN '$' ELSE '$-1' END ELSE response END AS response, count(*) AS n FROM answered GROUP BY 1", log=False)
def kv_response_histogram(spark, sf_dir):
    answered = commands.evaluate(commands.parsed(_lines(spark, sf_dir)))
    kind = F.when(F.col("response").startswith("$"), F.when(F.col("hit"), "$").otherwise("$-1")).otherwise(F.col("response"))
    return answered.groupBy(kind.alias("response")).agg(F.count(F.lit(1)).alias("n"))


@query("""
, quits AS (SELECT conn, min(seq) AS quit FROM cl WHERE seq % 1009 = 1008 GROUP BY conn)
SELECT seq, conn, CASE WHEN seq % 1009 = 1008 THEN 'QUIT' ELSE verb END AS verb FROM cl LEFT JOIN quits USING (conn) WHERE quit IS NULL OR seq <= quit""", log=False)
def kv_quit_truncation(spark, sf_dir):
    """Every 1009th line is a QUIT instead; it ends its connection."""
    lines = _lines(spark, sf_dir).withColumn("line", F.when(F.col("seq") % 1009 == 1008, "quit now").otherwise(F.col("line")))
    return commands.until_quit(commands.parsed(lines)).select("seq", "conn", "verb")


@query("""
, stored AS (
  SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, verb, key, CASE WHEN verb IN ('GET', 'DEL') THEN coalesce(prev.value IS NOT NULL, false) END AS hit, prev.value AS found FROM seen
)
SELECT seq, verb, key, hit, CASE verb WHEN 'PING' THEN '+PONG' WHEN 'SET' THEN '+OK' WHEN 'GET' THEN '$' || CASE WHEN hit THEN found ELSE '-1' END ELSE ':' || CASE WHEN hit THEN 1 ELSE 0 END END AS response
FROM stored""", log=False)
def kv_command_file(spark, sf_dir):
    """The command log as text files, whose lines end as a client sends them; they are read, numbered and run against a new store at one time."""
    source = _lines(spark, sf_dir)
    text = source.select("seq", F.concat("line", F.lit("\r")).alias("value")).repartitionByRange("seq").sortWithinPartitions("seq").select("value")
    text.write.option("lineSep", "\n").text(path := new_path(spark, "commands"))
    return serve.execute_files(Store(spark, new_path(spark, "served"), clock=lambda: 1), path)


# --------------------------------------------------------------------------- load reports
@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type")
def kv_bench_latency(spark, sf_dir):
    """The events' values stand for latencies."""
    return load_report.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])


@query("SELECT conn, count(*) AS n, CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / 1000 AS elapsed_s, count(*) / (CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / 1000) AS per_s FROM cl GROUP BY conn", log=False)
def kv_bench_throughput(spark, sf_dir):
    return load_report.throughput(_lines(spark, sf_dir), (F.max("ts_ms") - F.min("ts_ms")).cast("double") / 1000, ["conn"])


@query("""
SELECT event_type, count(*) AS n, span AS elapsed_s, count(*) / span AS per_s, quantile_disc(ns, 0.5) / 1e6 AS p50_ms, quantile_disc(ns, 0.95) / 1e6 AS p95_ms, quantile_disc(ns, 0.99) / 1e6 AS p99_ms, max(ns) / 1e6 AS max_ms
FROM (SELECT event_type, CAST(floor(value * 1000000) AS BIGINT) AS ns, CAST(max(epoch_us(ts) // 1000) OVER w - min(epoch_us(ts) // 1000) OVER w AS DOUBLE) / 1000 AS span FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type, span""")
def kv_bench_report(spark, sf_dir):
    """Throughput and latencies in one row; the events' values stand for milliseconds, taken in nanoseconds."""
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.floor(F.col("value") * 1_000_000).cast("long").alias("ns"))
    return load_report.report(samples, (F.max("ts_ms") - F.min("ts_ms")).cast("double") / 1000, "ns", ["event_type"])


# --------------------------------------------------------------------------- whole stores
def _in_store(spark: SparkSession, log: DataFrame, name: str) -> Store:
    now = log.agg(F.max("ts_ms")).first()[0] or 0
    return Store(spark, new_path(spark, name), flush_bytes=1000, trigger=2, clock=lambda: now)


def _text(df: DataFrame) -> DataFrame:
    return df.select(cells.utf8(F.col("key")).alias("key"), cells.utf8(F.col("value")).alias("value"), "expiry_ms")


@query("SELECT key, value, expiry_ms FROM live")
def kv_store_roundtrip(spark, sf_dir):
    """The log goes into a store in three batches, through flushes and a compaction; the store is opened again and read."""
    log = _log(spark, sf_dir)
    store = _in_store(spark, log, "store")
    third = (log.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    for k in range(3):
        store.append(log.filter((F.col("seq") >= k * third) & (F.col("seq") < (k + 1) * third)))
    store.vacuum()
    return _text(Store(spark, store.base, clock=store.clock).snapshot())


@query("SELECT key, value, expiry_ms FROM live")
def kv_stream_ingest(spark, sf_dir):
    """The event table as a stream into a store, then read."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    store = _in_store(spark, events.mutations(source), "live")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque[t]")
    ingest.into(events.mutations(stream), store, f"{store.base}/checkpoint", available_now=True).awaitTermination()
    return _text(store.snapshot())
