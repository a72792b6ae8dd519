"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. A source's budget is met by whole copies of all its documents plus those
documents whose hash lies below a threshold. The threshold is found without sorting: words are summed
by source and leading hash bits, the bucket in which the budget falls is opened with the next bits, and so
on (budgets nest: a larger budget of the same source only adds documents). The last step takes the
boundary hash if that brings the sum nearer to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: The hash has LEVELS x BITS bits; a level's histogram has 2^BITS buckets for each source.
LEVELS, BITS = 6, 10
#: Sources that one task orders at once.
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def doc_hash(doc_id):
    """60 bits of the MD5 of the doc_id in decimal (null: of an empty string): the same on every run and in any SQL."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _source_key(source):
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, src, h, size): src is the source, never null."""
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), _source_key(source).alias("src"),
        doc_hash(F.col("doc_id").cast("long")).alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], part_rows: int) -> DataFrame:
    """``rows`` with the sums, by ``order``, over all rows before each. ``rows``: a written table.

    Up to ``part_rows`` rows are one task's work. More are dealt into ranges of the order: within a range a window sums, and what comes
    before it is a row for each range.
    """
    ranges = -(-rows.count() // part_rows)
    if ranges <= 1:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    carry = per.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    return own.join(carry, "_range").select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, part_rows: int = SOURCES) -> DataFrame:
    """(src, source_size, target): one row for each source.

    Sources by code point, null last, take the weights in turn. All sizes are shared by weight; a
    target stops at ``max_copies`` times its source's size and the excess is shared again by weight.
    That ends at target = min(cap, level x weight): in order of cap / weight, the sources before the level
    are the capped ones. A task sees ``part_rows`` sources, however many there are.
    """
    per = materialize(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    place = _before(per, [F.when(F.col("src") == "n", 1).otherwise(0).asc(), F.col("src").asc()], {"place": F.lit(1)}, part_rows)
    n = len(weights)
    per = place.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(n)) + 1).cast("int"))).drop("place")
    per = materialize(per.withColumn("cap", F.col("source_size") * max_copies), "weighed")
    total, all_w = per.agg(F.sum("source_size")).scalar(), per.agg(F.sum("w")).scalar()
    ranked = _before(per, [(F.col("cap") / F.col("w")).asc(), F.col("src").asc()], {"capped": F.col("cap"), "before_w": F.col("w")}, part_rows)
    ranked = materialize(ranked.select("*", ((total - F.col("capped")) / (all_w - F.col("before_w"))).alias("level")), "ranked")
    # the first source in this order whose cap is not below its level sets the level; from there on it only falls
    level = ranked.agg(F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")))).scalar()
    return ranked.select("src", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(src, below): of each source with a ``rest`` to meet, documents with h < below are taken once more.

    ``budgets``: (src, rest double), one row a source. Each level sums words by source and hash bucket within
    the boundary bucket of the level before.
    """
    at = materialize(budgets.filter("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("prefix")), "budgets")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sizes.join(at, "src").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
        last = Window.partitionBy("src")
        # the bucket in which the sum reaches the rest; rounding may leave it just beyond the last one
        boundary = summed.withColumn("end", F.max("bucket").over(last)).filter("upto >= rest and before < rest or bucket = end and upto < rest")
        at = materialize(boundary.select("src", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "words"), "boundary")
        if level < LEVELS:
            at = at.drop("words")
    return at.select("src", (F.col("prefix") + F.when(F.col("words") - F.col("rest") <= F.col("rest"), 1).otherwise(0)).alias("below"))


def plan(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target, base, below): ``base`` copies of every document, one more where h < below."""
    aims = materialize(targets(sizes), "targets")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
    aims = aims.withColumn("base", base)
    found = thresholds(sizes, aims.select("src", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest")))
    return materialize(aims.join(found, "src", "left").withColumn("below", F.coalesce("below", F.lit(0))), "plan")


def copies():
    return F.col("base") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``.

    ``taken`` is a multiple of the document's size. Null or empty text: size 0, takes nothing. A null
    source is a source, last in order. Rows with the same doc_id share a hash and are taken
    together. A source without words has target 0. An empty table gives an empty result. Reruns agree, on any layout.
    Other columns, whatever their names, are not read; words are counted in the JVM, over the whole text.
    """
    sizes = materialize(sized(docs), "sizes")
    return sizes.join(plan(sizes), "src").select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with all its columns."""
    sizes = materialize(sized(docs), "sizes")
    chosen = plan(sizes).select("src", "base", "below")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, _source_key(F.col("source").cast("string")).alias("src"), doc_hash(F.col("doc_id").cast("long")).alias("h"))
    often = keyed.join(chosen, "src").withColumn("n", copies()).filter("n > 0")
    return often.select("row", F.explode(F.expr("sequence(1, n)"))).select("row.*")
