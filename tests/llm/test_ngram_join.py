"""The Jaccard join against brute force over sets of five-word shingles."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

from marginalia.llm import ngram_join

SCHEMA = "doc_id bigint, text string, sid string, n string, root string, key string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), d) if x is not None), default=None)
    return sorted(((d, len(sets[k]), least[root(k)] if sets[k] else d) for k, (d, _) in enumerate(rows)), key=repr)


def corpus():
    draw = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  words", "a b c d e", "a b c d e f", "a b c d e f g"]
    common = draw.choices(words, k=60)  # a passage that many documents hold
    for _ in range(10):
        base = draw.choices(words, k=draw.randrange(60, 300))
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.randrange(0, 2 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    for k in range(60):
        texts.append(" ".join([*common, *draw.choices(words, k=3 + k % 12)]))
    chain = draw.choices(words, k=150)
    for k in range(120):  # one large group whose ends are not alike
        chain[(7 * k) % 150] = draw.choice(words)
        texts.append(" ".join(chain))
    return texts + texts[10:30]


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_BYTES", 8 * 800)
    monkeypatch.setattr(ngram_join, "RANGE_SIZE", 1500)
    rows = [(k if k % 9 else -k, t) for k, t in enumerate(corpus())]
    rows += [(None, "a null id"), (None, rows[40][1]), (5, rows[50][1]), rows[60], (2**60, rows[70][1] + " End")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute(rows)
    sizes = Counter(r[2] for r in got)
    assert max(sizes.values()) > 60 and len(sizes) > 30
    assert ngram_join.jaccard_components(docs.limit(0)).collect() == []


def test_prefixes_are_rare_first(monkeypatch):
    """Chunks, blocks and answers give each set the shared part of its prefix in the order of frequency."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "TOP", 2)
    sets = [ngram_join.shingles_of(t) for t in corpus()]
    chunks, own, sent = [ngram_join.Chunk(3) for _ in range(4)], {}, {}
    for k, x in enumerate(sets):
        if x.size:
            chunks[k % 4].add(x)
    by_range = {}
    for c in chunks:
        for place, chunk, blocks, data in c.close():
            if place < 0:
                own[chunk] = data
                sent[chunk] = []
            else:
                by_range.setdefault(place, []).append((chunk, data))
    for held in by_range.values():
        for (chunk, _), data in zip(held, ngram_join.answer([d for _, d in held])):
            sent[chunk].append(data)
    got = {}
    for chunk, data in own.items():
        for key, sid, n, alone, place in zip(*(x.tolist() for x in ngram_join.chunk_prefixes(data, sent[chunk]))):
            got.setdefault(sid, {}).setdefault(chunk, []).append((key, n, alone, place))
    frequency, keys = Counter(), {}
    for k in range(4):  # a set in two chunks counts in each
        for x in {ngram_join.set_id(x): x for x in sets[k::4] if x.size}.values():
            keys[ngram_join.set_id(x)] = (x.size, sorted({int(h) >> 16 for h in x}))
            frequency.update(keys[ngram_join.set_id(x)][1])
    for sid, (n, mine) in keys.items():
        ranked = sorted(mine, key=lambda h: (min(frequency[h].bit_length() - 1, 2), h))
        alone = sum(frequency[h] == 1 for h in mine)
        want = [(h, n, alone, r) for r, h in enumerate(ranked[: ngram_join.prefix_length(n)]) if frequency[h] > 1]
        assert all(x == want for x in got[sid].values()) if want else sid not in got


def test_packing_and_limits():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2) + np.uint64(1), np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64)]
    assert all((a == b).all() and a.size == b.size for a, b in zip(arrays, ngram_join.unpack(ngram_join.pack(*arrays))))
    assert [ngram_join.prefix_length(n) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]
    assert ngram_join.enough(8, 18) and not ngram_join.enough(79, 179)
