import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, simhash

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_against_brute_force(docs, documents, empty):
    groups = defaultdict(list)
    for r in documents:
        groups[WHITE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    want = sorted((d, min(g)[1], len(g), d == min(g)[1]) for g in groups.values() for _, d in g)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == want
    # identifiers that stand for several contents are told apart
    weak = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, identifier=lambda c: F.pmod(F.xxhash64(c), F.lit(3))).collect())
    assert weak == want
    assert exact_dedup.exact_duplicates(empty).collect() == []
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in want})


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, fa), (b, fb) in combinations(rows, 2):
        if bin(fa ^ fb).count("1") <= 3 and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


def test_simhash_against_brute_force(docs, documents, empty):
    want = [(r[0], brute_fingerprint(r[1])) for r in documents]
    of = brute_components(want)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert sorted((r.doc_id, r.f, r.component_id) for r in got) == sorted((d, f"{f:016x}", of[d]) for d, f in want)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_links_of_chains_and_dense_groups(spark):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 40).tolist())
    for seed in list(fps)[:3]:
        fps |= {seed ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (120, 3))}
    x = 12345
    for b in range(0, 60, 3):
        x ^= 7 << b
        fps.add(x)
    rows = list(enumerate(sorted(fps)))
    of = brute_components(rows)
    links = simhash.verified_links(spark.createDataFrame([(f,) for _, f in rows], "fp bigint"))
    found = {r.node: r.root for r in simhash.components(links).collect()}
    groups, mine = defaultdict(set), defaultdict(set)
    for d, f in rows:
        groups[of[d]].add(f)
        mine[found.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


REPEATED = [(7, "twice the same"), (7, "twice the same"), (5, "a copy of one"), (1, "a copy of one"), (5, "something of its own entirely"), (None, "a copy  of one"), (-(1 << 63), "least id"), (3, "least id"), (None, None), (None, ""), (9, "  ")]


def test_stages_decide_by_row(spark):
    """Ids that repeat or are null keep no copy alive, and rows that repeat whole leave one."""
    docs = spark.createDataFrame([(d, t, "x") for d, t in REPEATED], "doc_id bigint, text string, kept string")
    found = exact_dedup.exact_duplicates(docs).collect()
    assert {r.keep_id for r in found if r.doc_id in (3, -(1 << 63))} == {-(1 << 63)} and len(found) == len(REPEATED)
    want = [(-(1 << 63), "least id"), (5, "something of its own entirely"), (7, "twice the same"), (9, "  "), (None, "a copy  of one")]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=key) == want
    near = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=key)
    assert near == [(-(1 << 63), "least id"), (1, "a copy of one"), (5, "something of its own entirely"), (7, "twice the same"), (9, "  ")]
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).collect() == []


def test_groups_are_whole():
    parts = [np.array(x) for x in ([1, 1, 2], [2], [2, 2, 2], [2, 3], [3, 4], [], [4])]
    out = [x[0].tolist() for x in simhash.whole_groups((p,) for p in parts)]
    assert sum(out, []) == [1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 4, 4]
    assert not any(set(a) & set(b) for a, b in combinations(out, 2))
