"""Suffix, exact and near dedup against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from palimpsest.llm import exact_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, size string, kept string, key int"


def frame(spark, rows):
    """(doc_id, text) rows with other columns, whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", 1) for i, t in rows], SCHEMA)


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randrange(1, 9))) for _ in range(words)]
    return [" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 120))) for _ in range(n)]


def awkward(seed=1):
    """Texts with equal, nearly equal and shared parts; ids in random order, a null and a repeated one."""
    rnd = random.Random(seed)
    base = prose(seed, 40)
    passage = " ".join(prose(seed + 1, 3))
    texts = [*base, *base[:6], base[7].upper(), None, "", "", " \n\t ", None, "aB", "Ab", "ÀB", "àb", passage, "x" + passage, passage[5:] + base[3], base[2] + passage, "ab" * 300, "ab" * 301, base[9] + " end", base[9] + " END"]
    ids = rnd.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[3], rows[3], (None, base[4]), (None, "only here"), (None, "only here")]


# --------------------------------------------------------------------------- op 1
def brute_suffix(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        body = (rows[i][1] or "").encode()
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            w = body[s : s + length]
            if w in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, gone in zip(body, covered, strict=True) if not gone)
        spans = sum(covered[k] and not (k and covered[k - 1]) for k in range(len(body)))
        out.append((rows[i][0], len(body), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("unit_bytes", "hot"), [(1, 4096), (3000, 4), (10_000_000, 2), (10_000_000, 4096)])
def test_suffix_dedup(spark, unit_bytes, hot):
    rows = awkward()
    got = suffix_dedup.removed(frame(spark, rows), unit_bytes=unit_bytes, hot=hot).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_suffix(rows)))


def test_suffix_dedup_gives_text_and_spans(spark):
    rows = [(2, "q" + "abcdefghij" * 12 + "z"), (1, "abcdefghij" * 12)]
    got = {r.doc_id: r for r in suffix_dedup.removed(frame(spark, rows), with_text=True).collect()}
    assert bytes(got[2].kept) == b"qz" and [tuple(s) for s in got[2].spans] == [(1, 121)]
    assert bytes(got[1].kept) == b"abcdefghij" and [tuple(s) for s in got[1].spans] == [(10, 120)]
    assert got[1].n_removed == 110


def test_buckets_are_equality_classes():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2300] = text[100:400]
    counts = np.array([500, 700, 2501])
    for length in (100, 24, 50, 10):
        sizes = np.array([800, 900, 2300])
        counts = sizes - length + 1
        firsts = np.cumsum(sizes) - sizes
        bucket, at = suffix_dedup.buckets(text, firsts, counts, length)
        windows = [text[a : a + length].tobytes() for a in at]
        assert len({*zip(windows, bucket.tolist(), strict=True)}) == len(set(windows)) == len(set(bucket.tolist()))


def test_every_window_has_the_anchor_of_its_content():
    body = (b"abcde" * 50 + bytes(range(256)) * 2) * 2
    x = np.frombuffer(body, np.uint8)
    h, first, count = suffix_dedup.segments(x, np.array([0]), np.array([len(x)]), 100, 24)
    assert count.sum() == len(x) - 99
    by = {}
    for a, f, c in zip(h.tolist(), first.tolist(), count.tolist(), strict=True):
        for s in range(f, f + c):
            assert by.setdefault(body[s : s + 100], a) == a


def test_a_units_masks_cost_little_however_many_classes_there_are():
    import time

    rnd = np.random.default_rng(5)
    cls, want = np.sort(rnd.integers(0, 31_250, 100_000)), rnd.random((2, 100_000)) < 0.3
    at = np.split(np.arange(len(cls)), np.flatnonzero(np.diff(cls)) + 1)
    masks = [{"cls": int(cls[of[0]]), "bits": np.packbits(want[0][of]).tobytes(), "hot": np.packbits(want[1][of]).tobytes()} for of in at]
    shuffled = rnd.permutation(len(cls))  # anchors come in no order of class
    began = time.process_time()
    keep, hot = suffix_dedup._masked(cls[shuffled], masks)
    assert time.process_time() - began < 0.2
    inverse = np.argsort(np.argsort(cls[shuffled], kind="stable"))
    assert keep.tolist() == want[0][inverse].tolist() and hot.tolist() == want[1][inverse].tolist()


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 777)
    x = np.frombuffer("".join(prose(3, 60)).encode(), np.uint8)
    a = suffix_dedup.segments(x, np.array([0]), np.array([len(x)]), 100, 24)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 20)
    b = suffix_dedup.segments(x, np.array([0]), np.array([len(x)]), 100, 24)
    assert np.repeat(a[0], a[2]).tolist() == np.repeat(b[0], b[2]).tolist()


# --------------------------------------------------------------------------- op 3
def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out, done = [], set()
    for i, t in rows:
        body = (t or "").encode().lower()
        win = max((x for x in groups[body] if x is not None), default=None)
        kept = i == win and body not in done
        if kept:
            done.add(body)
        out.append((i, win, len(groups[body]), kept, hashlib.sha256(body).hexdigest()))
    return out


@pytest.mark.parametrize("history", [None, -1, 500, 10_000])
def test_exact_dedup(spark, history):
    rows = awkward(2)
    got = exact_dedup.exact_groups(frame(spark, rows), history).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_exact(rows)))
    if history is None:
        kept = exact_dedup.keep_one(frame(spark, rows))
        expected = [(r[0], r[4]) for r in brute_exact(rows) if r[3]]
        assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode().lower()).hexdigest()) for r in kept.collect()) == sorted((str(a), b) for a, b in expected)
        assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    mph = exact_dedup.PerfectHash(digests)
    assert sorted(mph.slots(digests).tolist()) == list(range(n))
    others = mph.slots([hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)])
    assert len(others) == 500 and others.max(initial=-1) < max(n, 1)


# --------------------------------------------------------------------------- op 6
def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def classes(ids_and_prints, radius=3):
    n = len(ids_and_prints)
    parent = list(range(n))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if (ids_and_prints[a][1] ^ ids_and_prints[b][1]).bit_count() <= radius:
                parent[top(a)] = top(b)
    low = {}
    for a, (i, _) in enumerate(ids_and_prints):
        if i is not None:
            low[top(a)] = min(low.get(top(a), i), i)
    return [low.get(top(a)) for a in range(n)]


def test_simhash(spark):
    long = " ".join(prose(9, 30))
    rows = [*awkward(3), *[(2000 + i, long + f" tail{i}") for i in range(12)], (3000, long)]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, classes(prints), strict=True)]
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert len({c for _, _, c in expected}) < len({p for _, p, _ in expected}), "the fixture has links between different fingerprints"
    for scheme in (simhash.SHINGLES, simhash.NEAR):
        assert kept_texts(simhash.keep_one(frame(spark, rows), scheme)) == brute_near(rows, scheme)


def kept_texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def brute_near(rows, scheme):
    """(doc_id, text) of the rows that stay: one for each class of linked texts."""

    def prints(t):
        words = (t or "").encode().lower().split()
        out = []
        for kind in [*scheme.prints, *([scheme.guard] if scheme.guard else [])]:
            shingles = [b" ".join(words[i : i + kind.n]) for i in range(len(words) - kind.n + 1)] or ([b" ".join(words)] if words else [])
            shingles = sorted(set(shingles)) if kind.distinct else shingles
            out.append(sum((2 * sum(xxhash.xxh64_intdigest(s, kind.seed) >> b & 1 for s in shingles) > len(shingles)) << b for b in range(64)))
        return out

    found = [prints(t) for _, t in rows]
    k = len(scheme.prints)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            near = any((x ^ y).bit_count() <= scheme.radius for x, y in zip(found[a][:k], found[b][:k], strict=True))
            if near and all((x ^ y).bit_count() <= scheme.guard_radius for x, y in zip(found[a][k:], found[b][k:], strict=True)):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    stay = {}
    for g, (i, t) in zip(group, rows, strict=True):
        me = (i is None, i or 0, hashlib.sha256((t or "").encode()).digest(), str(i), t or "")
        stay[g] = min(stay.get(g, me), me)
    return sorted(x[3:] for x in stay.values())


def test_near_dedup_keeps_a_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d, e = [t for t in prose(31, 60) if len(t.split()) > 60][:5]
    rows = [(5, a), (5, b), (None, c), (None, d), (None, e), (7, a + " x"), (None, b + " y"), (5, a), (5, a), (None, e), (8, None), (None, ""), (8, None)]
    for scheme, rounds in ((simhash.SHINGLES, rows), (simhash.NEAR, rows[::-1])):
        got = kept_texts(simhash.keep_one(frame(spark, rounds), scheme))
        assert got == brute_near(rounds, scheme)
        assert {t for _, t in got} >= {c, d, e, ""} and len(got) == len(set(got))


def test_near_copies_are_found_and_others_left_alone(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(2000)]
    rows, near = [], []
    for i in range(300):
        base = rnd.choices(words, k=rnd.randrange(80, 400))
        copy = list(base)
        while True:  # as many words change as leave five-word shingles a similarity of 0.8, or 0.9
            edited = list(copy)
            edited[rnd.randrange(len(edited))] = rnd.choice(words)
            one, two = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, edited))
            if len(one & two) < (0.8 + 0.1 * (i % 2)) * len(one | two):
                break
            copy = edited
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    stay = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert all(2 * i in stay for i in range(300)), "no text goes but as a near copy of another"
    gone = [2 * i + 1 not in stay for i in range(300)]
    assert sum(gone[::2]) >= 0.8 * 150 and sum(gone[1::2]) >= 0.97 * 150 and sum(gone) >= 0.9 * 300


def test_masks_cover_every_pair_within_the_radius():
    import itertools

    for radius, bits in ((1, 20), (2, 20), (3, 16)):
        tables = [m & (1 << bits) - 1 for m in simhash.masks(radius, bits)]
        for r in range(radius + 1):
            for at in itertools.combinations(range(bits), r):
                assert any(not m & sum(1 << i for i in at) for m in tables)


def test_chains_of_links(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(40):
        p = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 40)):
            rows.append(p)
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in rows]
    df = spark.createDataFrame([(i, b"", p) for i, p in enumerate(signed)], "doc_id long, key binary, fp0 long")
    found = simhash._with_lows(simhash._rooted(df, simhash.SHINGLES))
    got = dict(df.join(found, "fp0").select("doc_id", "first.doc_id").collect())
    assert got == dict(enumerate(classes(list(enumerate(rows)))))


def test_large_buckets_are_split(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 16)
    rnd = random.Random(6)
    fps = np.unique(np.array([rnd.getrandbits(10) for _ in range(400)], np.uint64))

    def count(links):
        parent = list(range(len(fps)))

        def top(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in links:
            parent[top(a)] = top(b)
        return [top(a) for a in range(len(fps))]

    exact = count([(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3])
    assert len(set(count(simhash.trees(fps)))) == len(set(exact))


# --------------------------------------------------------------------------- all
def test_empty_tables(spark):
    none = frame(spark, [])
    for found in (suffix_dedup.removed(none), exact_dedup.exact_groups(none), exact_dedup.keep_one(none), simhash.near_groups(none), simhash.keep_one(none)):
        assert found.count() == 0
