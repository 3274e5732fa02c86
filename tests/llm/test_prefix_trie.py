"""The trie against a dictionary of prefixes built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from marginalia.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, d string, node string, words string, at string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in turns:
        h, leader = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        seq = turns.get(leader, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        w = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += w
            leaves[p[:d]] += not children[p]
    smallest = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (smallest[p], len(p), smallest[p[:-1]] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "e") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).collect())


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    draw = random.Random(6)
    rows = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, "user", ""), (7, 1, "user", "x"), (7, 1, "user", "x")]
    for c in [*range(8, 60), 2**40, 2**40 + 3, -5, -40]:  # 40 leads; 20 and 0 may be short
        turns = ["one word", "two  words\there", "", "three more words"]
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(turns)) for t in range(draw.choice([1, 1, 2, 3, 9]))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)]  # a large group of copies
    rows += [(61, t, "user", f"long {t % 3}") for t in range(23)] + [(62, t, "user", f"long {t % 3}") for t in range(23)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert max(r[1] for r in got) >= 20 and any(r[3] >= 40 for r in got)


def test_turnless_and_empty(spark):
    # h of 1 is 3 or less; a conversation shorter than that, whose leader is absent, has no turns
    c = next(k for k in range(21, 40) if zlib.crc32(str(k).encode()) % 4 == 3)
    assert found(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute([(c, 0, "user", "gone")])
    assert found(spark, []) == []
