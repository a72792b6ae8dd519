"""Corpus pipeline: from ``documents`` to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, and any others that docs has, whatever
their names. Nulls in any column, empty and very long texts, ties, repeated rows and empty tables are dealt with as the
stages' operators say; in short: a null text is an empty one, a null doc_id, language or source is a value of its own, and of rows
that tie in everything that decides one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, mixing, pow2_packing, quality, simhash
from palimpsest.plans.shared import new_path, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff of their language reject go; empty texts fail the base rules."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one document with the smallest doc_id stays.

    The scheme is ``simhash.NEAR``: texts whose five-word shingles have a similarity of 0.8 or more, with the recall that README gives.
    """
    return simhash.keep_one(docs, simhash.NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that the sources' words come near their targets."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of power-of-two lengths, with their token ids."""
    return pow2_packing.packed(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Binomial bounds, fingerprints and token ids are beyond SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's intermediates are deleted when its result is written; the results stay until the folder is cleaned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scope(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
