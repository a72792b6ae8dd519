"""Toxicity by a classifier chain.

Categories are predicted in turn; the model of a category sees the words of the text and the probabilities of
the categories before it. In training those are out-of-fold predictions, so that a later model does not
learn from fitted values that an earlier one would never give on new text. Models are logistic regressions
on hashed words, each word scaled by its log count ratio between the classes.

The categories are those that the labels know: toxic text, and its two kinds, toxic prose of good quality (an insult in
passing) and toxic junk. A kind names its parent: it is never more probable than that, and flagged only where that is.

The models are fitted on at most ``max_labelled`` labelled documents, those with the smallest hash of
doc_id (a documented bound); every document is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bodies, materialize, text_bytes, tidy

MAX_LABELLED, DIMENSIONS, FOLDS, ROUNDS = 12_000, 1 << 18, 5, 80
#: Words whose chi-square with the category is below this get no weight.
SURPRISE = 20.0
#: Chain: category and how a label row gives it, parents first; and the parents of kinds.
CHAIN = {"toxic": "toxic = 1", "toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0"}
PARENTS = {"toxic_prose": "toxic", "toxic_junk": "toxic"}
_BREAKS = bytes(range(0x30)) + b":;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def words(body: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sorted distinct indexes of the lower-cased words of a whole text; punctuation parts words."""
    distinct = set(body.lower().translate(_TO_SPACE).split())
    return np.unique(np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) & (dimensions - 1))


@dataclass
class Linear:
    weights: np.ndarray  # of words; the scaling is multiplied in
    extra: np.ndarray  # of the earlier categories' probabilities
    bias: float

    def log_odds(self, index: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
        return _sums(self.weights[index], starts) + before @ self.extra + self.bias


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the slices that begin at ``starts`` (the last entry is the end); an empty slice is 0."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def _pick(index: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = (starts[1:] - starts[:-1])[rows]
    new = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[:-1][rows] - new[:-1], lengths) + np.arange(new[-1])
    return index[at], new


def fit(index: np.ndarray, starts: np.ndarray, before: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, penalty: float = 1.0) -> Linear:
    """Logistic regression by full-batch adaptive gradients; a single class gives a constant."""
    n, ones = len(y), float(y.sum())
    if not 0 < ones < n:
        return Linear(np.zeros(dimensions), np.zeros(before.shape[1]), -10.0 if ones == 0 else 10.0)
    lengths = starts[1:] - starts[:-1]
    with_word = np.bincount(index, np.repeat(y, lengths), dimensions)
    all_words = np.bincount(index, minlength=dimensions)
    ratio = np.log((with_word + 0.5) / (ones + 1)) - np.log((all_words - with_word + 0.5) / (n - ones + 1))
    expected = all_words * (ones / n)
    surprise = (with_word - expected) ** 2 / np.maximum(expected * (1 - ones / n), 1e-9)
    ratio[(surprise < SURPRISE) | (all_words < 3)] = 0.0  # chance; in long texts its sum would drown what is known
    rows = np.repeat(np.arange(n), lengths)
    known = ratio[index] != 0
    index, rows = index[known], rows[known]
    starts = np.searchsorted(rows, np.arange(n + 1))
    scale = ratio[index]
    w, extra, bias = np.zeros(dimensions), np.zeros(before.shape[1]), np.log(ones / (n - ones))
    seen_w, seen_e, seen_b = np.full(dimensions, 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        z = _sums(w[index] * scale, starts) + before @ extra + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(index, error[rows] * scale, dimensions) + penalty * w
        ge, gb = before.T @ error + penalty * extra, float(error.sum())
        seen_w, seen_e, seen_b = seen_w + g * g, seen_e + ge * ge, seen_b + gb * gb
        w -= 0.3 * g / np.sqrt(seen_w)
        extra -= 0.1 * ge / np.sqrt(seen_e)
        bias -= 0.3 * gb / np.sqrt(seen_b)
    return Linear(w * ratio, extra, bias)


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def fit_chain(index: np.ndarray, starts: np.ndarray, fold: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[list[Linear], list[float]]:
    """Models of the categories (columns of ``labels``) and, for each, the log odds from which it is assigned.

    A later category sees the earlier ones' out-of-fold probabilities; the cutoffs maximise F1 out of fold.
    """
    models, cuts = [], []
    before = np.zeros((len(fold), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out = np.zeros(len(y))
        for f in range(FOLDS):
            test = np.flatnonzero(fold == f)
            if len(test):
                train = np.flatnonzero(fold != f)
                model = fit(*_pick(index, starts, train), before[train], y[train], dimensions)
                out[test] = model.log_odds(*_pick(index, starts, test), before[test])
        models.append(fit(index, starts, before, y, dimensions))
        cuts.append(_best_cut(np.clip(out, -30, 30), y))
        before = np.column_stack([before, probability(out)])
    return models, cuts


def predict_chain(models: list[Linear], cuts: list[float], own: np.ndarray, names: list[str], parents: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, flags) by document and category. ``own``: sums of the words' weights."""
    p, flags = np.zeros(own.shape), np.zeros(own.shape, bool)
    for k, m in enumerate(models):
        z = np.clip(own[:, k] + p[:, :k] @ m.extra + m.bias, -30, 30)
        p[:, k], flags[:, k] = probability(z), z > cuts[k]
    for k, name in enumerate(names):  # once all are predicted: models see what they were trained on
        if name in parents:
            at = names.index(parents[name])
            p[:, k], flags[:, k] = np.minimum(p[:, k], p[:, at]), flags[:, k] & flags[:, at]
    return p, flags


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    last = np.flatnonzero(np.append(np.diff(z[order]) != 0, True)) if len(z) else np.zeros(0, np.int64)
    if not len(last) or not hit[-1]:
        return 0.0
    f1 = 2 * hit[last] / (last + 1 + hit[-1])
    best = int(last[int(np.argmax(f1))])
    return float((z[order][best] + z[order][best + 1]) / 2) if best + 1 < len(z) else 0.0


def sample(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, y): the ``max_labelled`` labelled documents with the least hash of doc_id; labels of absent documents take no place.

    A cut of the hash that twice as many ids should pass comes first, so that no task meets many more.
    """
    ys = F.array(*[F.expr(rule).cast("int") for rule in chain.values()])
    known = labels.select(F.col("doc_id").cast("long").alias("id"), ys.alias("y")).filter("id is not null and not exists(y, v -> v is null)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    known = materialize(known, "known")
    total = known.count()
    cut = (2 * max_labelled + 100) * 2**64 // max(1, total) - 2**63
    few = known.filter(F.xxhash64("id") < cut) if cut < 2**63 else known
    few = few if few.count() >= max_labelled else known
    return materialize(few.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "sample")


def labelled_words(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, y, words) of the bounded sample of labelled documents; the sample's ids are the only broadcast."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    held = text_bytes(plain, "doc_id").join(F.broadcast(sample(docs, labels, chain, max_labelled)), F.col("doc_id") == F.col("id")).select("doc_id", "y", "body")

    def run(texts: pa.Array) -> pa.Array:
        tidy()
        return pa.array([words(x, dimensions).astype(np.int32) for x in bodies(texts)], pa.list_(pa.int32()))

    found = held.select("doc_id", "y", F.arrow_udf(run, "array<int>")("body").alias("words"))
    return found.groupBy("doc_id").agg(F.min(F.struct("y", "words")).alias("r")).select("doc_id", "r.*")


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> tuple[list[Linear], list[float]]:
    """Fit the chain in one task over the bounded sample; the models (``dimensions`` weights each) come to the driver."""
    kinds = len(chain)

    def run(table: pa.Table) -> pa.Table:
        tidy()
        table = table.sort_by("doc_id")
        lists = table.column("words").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        index, starts = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        ids = table.column("doc_id").to_numpy()
        fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids])
        models, cuts = fit_chain(index, starts, fold, np.array(table.column("y").to_pylist()).reshape(-1, kinds), dimensions)
        return pa.table({"k": pa.array(range(kinds), pa.int32()), "weights": pa.array([m.weights.astype("<f4").tobytes() for m in models], pa.binary()), "extra": pa.array([m.extra.tolist() for m in models], pa.list_(pa.float64())), "bias": [float(m.bias) for m in models], "cut": cuts})

    held = labelled_words(docs, labels, chain, max_labelled, dimensions)
    fitted = held.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "k int, weights binary, extra array<double>, bias double, cut double").collect()
    models, cuts = [Linear(np.zeros(dimensions), np.zeros(k), -10.0) for k in range(kinds)], [0.0] * kinds
    for r in fitted:
        models[r.k], cuts[r.k] = Linear(np.frombuffer(r.weights, "<f4").astype(float), np.array(r.extra, float), r.bias), r.cut
    return models, cuts


def scored(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, parents: dict[str, str] = PARENTS) -> DataFrame:
    """(doc_id, p_<category>..., <category> boolean...) for each row of ``docs``.

    Null or empty text: no words, the prior alone. Null doc_id: scored, never trained on. Label rows
    with a null are not used; without labels every probability is near 0 and nothing is flagged. A
    document labelled twice takes the larger label; of rows with one doc_id one is trained on. Rows with equal texts score alike. An empty table
    gives an empty result. Only doc_id and text are read. A text is read whole; beside it a task holds its distinct words.
    """
    models, cuts = train(docs, labels, chain, max_labelled, dimensions)
    names = list(chain)
    kept = {c: p for c, p in parents.items() if c in chain and p in chain}
    shared = docs.sparkSession.sparkContext.broadcast((np.stack([m.weights for m in models]).astype(np.float32), [Linear(np.zeros(0), m.extra, m.bias) for m in models]))  # kinds x dimensions weights

    def run(texts: pa.Array) -> pa.Array:
        tidy()
        weights, rest = shared.value
        own = np.zeros((len(texts), len(names)))
        for i, body in enumerate(bodies(texts)):
            own[i] = weights[:, words(body, dimensions)].sum(axis=1, dtype=np.float64)
        p, flags = predict_chain(rest, cuts, own, names, kept)
        p = np.round(p, 6)
        columns = [*[pa.array(p[:, k]) for k in range(len(names))], *[pa.array(flags[:, k]) for k in range(len(names))]]
        return pa.StructArray.from_arrays(columns, [*[f"p_{c}" for c in names], *names])

    schema = "struct<" + ", ".join(f"p_{c}: double" for c in names) + ", " + ", ".join(f"{c}: boolean" for c in names) + ">"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(run, schema)(F.col("text").cast("binary")).alias("r"))
    return found.select("doc_id", "r.*")
