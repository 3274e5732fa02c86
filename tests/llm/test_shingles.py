"""The near_dedup stage against brute force over sets of five-word shingles."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from marginalia.llm import shingles
from tests.llm.test_dedup import brute_fingerprint


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_stage_links_every_similar_pair(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    texts = [None, "", "two words", "two  words", "other words"]
    for _ in range(12):
        base = draw.choices(words, k=draw.randrange(60, 300))
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.randrange(1, 2 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    base = draw.choices(words, k=200)
    for k in range(80):  # one large group, and a chain away from it
        texts.append(" ".join([*base[:190], *draw.choices(words, k=10)]))
        if k % 8 == 0:
            base[20 * (k // 8) : 20 * (k // 8) + 6] = draw.choices(words, k=6)
    rows = list(enumerate(texts))
    sets, fps = [shingle_set(t) for t in texts], [brute_fingerprint(t) for t in texts]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    near = only = 0
    for a, b in combinations(range(len(rows)), 2):
        alike = sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        within = bin(fps[a] ^ fps[b]).count("1") <= 3
        near, only = near + within, only + (bool(alike) and not within)
        if (alike or within) and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert only > 100
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert got == {k for k, _ in rows if root(k) == k}
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").collect() == []


def test_minima_estimate_similarity():
    """For sets of every kind, agreeing lanes are about the similarity, and those of other sets hardly agree."""
    draw = random.Random(4)
    for n in (60, 450, 560, 3000):
        off = []
        for _ in range(60):
            a = [b"%d" % draw.randrange(10**6) for _ in range(n)]
            b = list(a)
            for _ in range(max(1, n // 45)):
                b[draw.randrange(n)] = b"x%d" % draw.randrange(10**6)
            x, y = shingles.shingle_set(a), shingles.shingle_set(b)
            low, other = dict(shingles.minima(x)), dict(shingles.minima(y))
            kind = min(set(low) & set(other))
            lanes, others = (np.frombuffer(shingles.lanes_of(m[kind]), np.uint16) for m in (low, other))
            off.append((lanes == others).mean() - np.intersect1d(x, y).size / np.union1d(x, y).size)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
    long = [b"w" * draw.randrange(1, 5000) for _ in range(400)]
    assert shingles.shingle_set(long).size == 396 and shingles.shingle_set([b"a"] * 9).size == 1 and shingles.shingle_set([]).size == 0


def test_cells_of_a_large_bucket():
    """Links within and between parts join the same components as one cell of all."""
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 63, (6, 100), np.uint64)
    sets = np.empty(60, object)
    sets[:] = [np.unique(np.concatenate([base[k % 6][:94], rng.integers(1, 1 << 63, 5, np.uint64)])) for k in range(60)]
    n, sid, part = np.array([x.size for x in sets]), np.arange(60), np.arange(60) // 30
    lanes = np.array([np.frombuffer(shingles.lanes_of(shingles.minima(x)[0][1]), np.uint16) for x in sets])
    links = list(shingles._cell(part[:30], sid[:30], sid[:30], n[:30], lanes[:30], sets[:30], True)) + list(shingles._cell(part[30:], sid[30:], sid[30:], n[30:], lanes[30:], sets[30:], True)) + list(shingles._cell(part, sid, sid, n, lanes, sets, False))
    up = list(range(60))
    for a, b in links:
        up = [up[a] if x == up[b] else x for x in up]
    assert len({(k % 6, up[k]) for k in range(60)}) == 6 == len(set(up))
