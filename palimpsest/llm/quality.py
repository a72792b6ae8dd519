"""Quality rules with risk-controlled thresholds.

Base rules have fixed limits. On top of them each stratum (language) gets cutoffs of four ratios that are certified on
labelled documents to reject few good ones. The labelled documents of a stratum, one for each distinct text, are parted in
two by their digest:

1. The *tuning* part orders the candidates: a path of cutoff vectors from loose to tight. It starts well beyond the largest
   ratio of a good tuning document, closes in on it, and then lets go of growing shares of them.
2. The *holdout* part certifies along the path: the exact (Clopper-Pearson) upper bound of the share of good documents that a
   vector rejects, by all its cutoffs together, must be at most ``risk``. Vectors are tested in order until the first that
   fails. Such a fixed sequence needs no correction for its length; strata are many tests, each at ``delta`` / strata (Bonferroni).

With probability 1 - ``delta`` no stratum's certified vectors reject more than ``risk`` of its good documents. Of the certified ones
that is used which parts bad from good tuning documents best. A stratum with too few good labels (93 in the holdout with
four strata, if none is lost) has no certified vector, and the base rules alone decide there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bodies, fresh, materialize, text_key, tidy

RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEATED_PER_CENT, WINDOW = 50, 50, 3
SPACES, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
#: Rule: numerator over denominator, rejected when above the cutoff; cutoffs are k / GRID of `top`.
RULES = {
    "symbols": ("n_symbols", "word_chars", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "word_length": ("word_chars", "n_words", 32.0),
}
GRID = 64
#: The path: so many grid steps beyond all good tuning documents, then so many of SHARES parts of the risk of them let go.
MARGINS, SHARES = (16, 8, 4, 2, 1), 8
STEPS = len(MARGINS) + SHARES + 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(body: bytes) -> tuple[int, int, int, int, int, int]:
    """The counts named in ``COUNTS`` for one whole text (UTF-8); n_lines are those with a word."""
    words = body.split()
    word_chars = len(body.translate(None, _NOT_IN_WORDS))  # a byte for each code point
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    lines = [x for x in body.split(b"\n") if x.strip()]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated(words), len(lines)


_NOT_IN_WORDS = SPACES + bytes(range(0x80, 0xC0))


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window that occurs twice or more in the text. Windows are numbers: eight bytes each, however long the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code, distinct = ids[:n], len(number)
    for i in range(1, window):
        if distinct * len(number) >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            distinct = len(found)
        code, distinct = code * len(number) + ids[i : i + n], distinct * len(number)
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(code, twice)
    hit = np.zeros(len(words), bool)
    for i in range(window):
        hit[i : i + n] |= at
    return int(hit.sum())


def _counted() -> Column:
    """STRUCT of ``COUNTS`` of the text: only texts go to Python, the other columns stay in the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        tidy()
        got = np.array([counts(x) for x in bodies(texts)], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(COUNTS))], list(COUNTS))

    return F.arrow_udf(run, "struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">")(F.col("text").cast("binary"))


def _failed(part: str = "") -> Column:
    words, again = F.col(f"{part}n_words"), F.col(f"{part}n_repeat_words")
    return (words < MIN_WORDS) | (100 * again > MAX_REPEATED_PER_CENT * words)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, key, counts..., base_failed) for each row; the stratum is the language, null for none; a null text has no words."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), text_key().alias("key"), _counted().alias("c"))
    return found.select("doc_id", "stratum", "key", "c.*").withColumn("base_failed", _failed())


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def certified(k: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound at ``level`` of a share with ``k`` of ``n`` seen is at most ``risk``."""
    return n > 0 and k < n * risk and _log_tail(k, n, risk) <= math.log(level)


def _bin(num: Column, den: Column, top: float) -> Column:
    """The number of grid cutoffs c = top * j / GRID (j = 0 .. GRID - 1) that the ratio exceeds; 0 without a denominator."""
    exact = F.ceil(num * GRID / (den * F.lit(top)))
    return F.when(den > 0, F.least(exact, F.lit(GRID))).otherwise(0).cast("int")


def _bins(part: str = "") -> dict[str, Column]:
    return {rule: _bin(F.col(f"{part}{num}"), F.col(f"{part}{den}"), top) for rule, (num, den, top) in RULES.items()}


def path(good: np.ndarray, bad: np.ndarray, risk: float) -> np.ndarray:
    """Cutoffs by step and rule (GRID: none), loose to tight. ``good``, ``bad``: tuning documents by rule and bin.

    At a step a rule's cutoff is the least that at most the step's share of the good exceed, plus the step's
    margin. A cutoff that no bad document exceeds stays out.
    """
    # beyond[r, j]: documents that cutoff j rejects (those in bins above j)
    beyond = lambda n: n.sum(axis=1, keepdims=True) - np.cumsum(n, axis=1)
    lost, caught = beyond(good), beyond(bad)
    out = np.full((STEPS, len(RULES)), GRID)
    for s in range(STEPS):
        share = max(0, s - len(MARGINS)) * risk / SHARES
        for r in range(len(RULES)):
            j = int(np.argmax(lost[r] <= share * good[r].sum()))
            j = min(j + (MARGINS[s] if s < len(MARGINS) else 0), GRID)
            if caught[r, j]:
                out[s, r] = j
    return np.minimum.accumulate(out, axis=0)


def chosen_step(good: np.ndarray, bad: np.ndarray, tuning_good: np.ndarray, tuning_bad: np.ndarray, risk: float, level: float) -> int | None:
    """The step to use. Arrays: documents by the first step that rejects them (STEPS: none); ``good`` of the holdout, the others of the tuning part.

    Steps are certified in order until one fails. Of those, the first that parts bad from good best; None if that is no
    better than to reject nothing.
    """
    best, step = 0.0, None
    share = lambda n, s: n[: s + 1].sum() / max(1, n.sum())
    for s in range(STEPS):
        if not certified(int(good[: s + 1].sum()), int(good.sum()), risk, level):
            break
        gain = share(tuning_bad, s) - share(tuning_good, s)
        if gain > best:
            best, step = gain, s
    return step


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, holdout, good, a bin for each rule): the labelled documents that pass the base rules, one for each distinct text of a stratum.

    A document labelled twice, or a text that several labelled documents share, is good only if all its labels say so.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).filter("q is not null and id is not null")
    one = one.groupBy("id").agg(F.min("q").alias("q"))
    bins = found.filter(~F.col("base_failed")).select("doc_id", "stratum", "key", *[c.alias(r) for r, c in _bins().items()])
    held = bins.join(one, bins["doc_id"] == one["id"]).groupBy("stratum", "key").agg((F.min("q") > 0).alias("good"), *[F.first(r).alias(r) for r in RULES])
    return held.select("stratum", (F.substring(F.hex("key"), 1, 1) >= "8").alias("holdout"), "good", *RULES)


def _first_step(rule: str) -> Column:
    """The first step whose cutoff of the rule lies below the document's bin; STEPS: none."""
    at = F.array_position(F.transform(f"w.{rule}", lambda j: j < F.col(rule)), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(STEPS).cast("int")


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, a column for each rule): a document is rejected if its bin exceeds the rule's cutoff; GRID: no cutoff.

    Labels are counted by stratum, part, label and bins. A task reads a stratum's tuning counts (at most
    rules x (GRID + 1) x 2) for its path and its counts by step for the certificate; only the number of strata comes to the
    driver. Strata without cutoffs are left out: one with any has a hundred good labels.
    """
    held = materialize(labelled(found, labels), "labelled")
    level = delta / max(1, held.select("stratum").distinct().count())
    paths = "stratum string, " + ", ".join(f"{r} array<int>" for r in RULES)

    def order(rows: pa.Table) -> pa.Table:
        n = np.zeros((2, len(RULES), GRID + 1), np.int64)
        for r in rows.to_pylist():
            n[int(r["good"]), r["rule"], r["bin"]] += r["n"]
        steps = path(n[1], n[0], risk)
        return pa.table({"stratum": pa.array(rows.column("stratum").to_pylist()[:1], pa.string()), **{r: pa.array([steps[:, i].tolist()], pa.list_(pa.int32())) for i, r in enumerate(RULES)}})

    long = held.filter("not holdout").select("stratum", "good", F.posexplode(F.array(*RULES)).alias("rule", "bin"))
    ways = materialize(long.groupBy("stratum", "good", "rule", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("stratum").applyInArrow(order, paths), "paths")
    first = F.least(*map(_first_step, RULES))
    w = ways.select(F.col("stratum").alias("_stratum"), F.struct(*RULES).alias("w"))
    stepped = held.join(w, F.col("stratum").eqNullSafe(F.col("_stratum"))).groupBy("stratum", "holdout", "good", first.alias("step")).agg(F.count(F.lit(1)).alias("n"))

    def choose(rows: pa.Table) -> pa.Table:
        n = np.zeros((2, 2, STEPS + 1), np.int64)
        for r in rows.to_pylist():
            n[int(r["holdout"]), int(r["good"]), r["step"]] += r["n"]
        step = chosen_step(n[1, 1], n[1, 0], n[0, 1], n[0, 0], risk, level)
        return pa.table({"stratum": pa.array(rows.column("stratum").to_pylist()[:1], pa.string()), "step": pa.array([step], pa.int32())})

    steps = stepped.groupBy("stratum").applyInArrow(choose, "stratum string, step int").filter("step is not null")
    s = steps.select(F.col("stratum").alias("_stratum"), "step")
    picked = ways.join(s, F.col("stratum").eqNullSafe(F.col("_stratum")))
    return materialize(picked.select("stratum", *[F.get(r, F.col("step")).alias(r) for r in RULES]), "cutoffs")


def _with_cutoffs(rows: DataFrame, chosen: DataFrame, stratum: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, a struct of the stratum's cutoffs or null.

    A language may hold most rows, so its few cutoffs are broadcast: a row for each of at most (labels / a hundred) strata.
    """
    key = fresh("cut_stratum", rows.columns)
    cut = chosen.select(F.col("stratum").alias(key), F.struct(*RULES).alias(name))
    return rows.join(F.broadcast(cut), stratum.eqNullSafe(F.col(key)), "left").drop(key)


def _beyond(cut: str, part: str = "") -> Column:
    beyond = F.lit(False)
    for rule, found in _bins(part).items():
        beyond = beyond | F.coalesce(found > F.col(f"{cut}.{rule}"), F.lit(False))
    return beyond


def verdicts(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``found`` with ``kept``: not base_failed and beyond no cutoff of its stratum."""
    rows = _with_cutoffs(found, cutoffs(found, labels, risk, delta), F.col("stratum"), "cut")
    return rows.withColumn("kept", ~F.col("base_failed") & ~_beyond("cut")).drop("cut")


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row.

    Null text: no words, so base_failed. Null lang: a stratum of its own. Null doc_id: judged, but
    never labelled. Repeated rows are judged alike and count as one label. Labels that are null, or of no document, do not
    count; no labels at all: the base rules alone decide. An empty table gives an empty result. Other columns are not read. A text is read whole;
    beside it a task holds its words and eight bytes for each of them.
    """
    found = materialize(features(docs), "features")
    return verdicts(found, labels, risk, delta).select("doc_id", *COUNTS[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The rows are written once with their counts beside them; cutoffs are found on the counts, and the same rows are then filtered.
    So texts are counted once and never shuffled, and neither repeated doc_ids nor clashing names matter.
    """
    c, cut = fresh("counts", docs.columns), fresh("cut", docs.columns)
    rows = materialize(docs.withColumn(c, _counted()), "counted")
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), text_key().alias("key"), f"{c}.*").withColumn("base_failed", _failed())
    marked = _with_cutoffs(rows, cutoffs(found, labels, risk, delta), F.col("lang").cast("string"), cut)
    return marked.filter(~_failed(f"{c}.") & ~_beyond(cut, f"{c}.")).select(*[F.col(f"`{x}`") for x in docs.columns])
