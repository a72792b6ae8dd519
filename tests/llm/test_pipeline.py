"""The corpus pipeline against a brute-force version of its stages, and what it must survive."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_dedup import brute_exact, brute_near
from test_operators import brute_mix, brute_quality, true_ids

import corpus_pipeline
from palimpsest.llm import pow2_packing, simhash

SF = "/root/testdata/sf0.001"


def brute_take(docs):
    per, target = brute_mix([(i, t, lang, s) for i, t, lang, s in docs])
    out = []
    for s in per:
        own = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, t, len((t or "").encode().split())) for i, t, _, src in docs if src == s)
        base = math.floor(target[s] / per[s] + 1e-12) if per[s] else 0
        rest = target[s] - base * per[s]
        sums = [0, *np.cumsum([x[3] for x in own]).tolist()]
        k = next((k for k in range(1, len(own) + 1) if sums[k] >= rest), len(own)) if rest > 0 else 0
        if k and not own[k - 1][3] - (rest - sums[k - 1]) <= rest - sums[k - 1]:
            k -= 1
        for n, (_, i, t, _) in enumerate(own):
            out += [(i, t)] * (base + (n < k))
    return out


def test_pipeline_equals_brute_force(spark):
    if not Path(SF).exists():
        pytest.skip("no test data")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    keep = brute_quality(docs, labels)
    docs = [d for d in docs if d[0] in keep]
    stay = {r[0] for r in brute_exact([d[:2] for d in docs]) if r[3]}
    docs = [d for d in docs if d[0] in stay]
    stay = {int(i) for i, _ in brute_near([d[:2] for d in docs], simhash.NEAR)}
    docs = [d for d in docs if d[0] in stay]
    expected = Counter()
    for i, t in brute_take(docs):
        ids = true_ids(t)
        for s, w in pow2_packing.pieces(len(ids)):
            expected[(i, s, w, zlib.crc32(np.array(ids[s : s + w], "<u4").tobytes()), len(ids), 0)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == expected
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


def test_stages_keep_columns_and_survive_oddities(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (None, text + " more", "en", None, 1, "x"), (5, text + " end", "en", "s", 9, "x"), (5, text + " end", "en", "s", 9, "x"), (6, text.upper(), "de", "t", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"], name
            docs = spark.createDataFrame(docs.collect(), schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == sum(len(pow2_packing.pieces(len(true_ids(r.text)))) for r in docs.collect())
        assert docs.count() > 0 or not some
