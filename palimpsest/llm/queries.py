"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bfd_packing, exact_dedup, mixing, oracles, pow2_packing, quality, sharding, simhash, suffix_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=40)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_table(spark, sf_dir, "pages"))


def op9_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.digested(_table(spark, sf_dir, "documents"))


def op10_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pow2_packing.packed(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_suffix_dedup, op2_sharding, op3_exact_dedup, op4_mixing, op5_quality, op6_simhash, op7_toxicity, op8_warc, op9_bfd_packing, op10_pow2_packing)
    return {f.__name__: f for f in found}


_OP3 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""


_OP4 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT src, CAST(sum(size) AS DOUBLE) AS source_size, 3 * CAST(sum(size) AS DOUBLE) AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY src = 'n', src) - 1) % 3 AS INTEGER) + 1] AS w
  FROM d GROUP BY src
), lev AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM per WINDOW before AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aim AS (
  SELECT src, source_size, least(cap, w * max(CASE WHEN cap >= (total - capped) / rest_w * w THEN (total - capped) / rest_w END) OVER ()) AS target FROM lev
), budget AS (
  SELECT *, target - base * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS base FROM aim)
), hashes AS (
  SELECT src, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY src ORDER BY h) AS upto, max(h) OVER (PARTITION BY src) AS last FROM d GROUP BY src, h
), cut AS (
  SELECT b.src, x.h + CASE WHEN x.words - (rest - (x.upto - x.words)) <= rest - (x.upto - x.words) THEN 1 ELSE 0 END AS below
  FROM budget b JOIN hashes x USING (src)
  WHERE rest > 0 AND (x.upto >= rest AND x.upto - x.words < rest OR x.h = x.last AND x.upto < rest)
)
SELECT d.doc_id, d.size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       d.size * (b.base + CASE WHEN d.h < coalesce(c.below, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN budget b USING (src) LEFT JOIN cut c USING (src)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": oracles.OP1, "op3_exact_dedup": _OP3, "op4_mixing": _OP4, "op5_quality": oracles.OP5}
