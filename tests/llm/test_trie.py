"""The conversation trie against nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from qaloom.llm import trie


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, label), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    members, end = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        end[path].append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = {q for q in below if len(q) == len(p) + 1}
        leaves = sum(not any(r[: len(q)] == q and len(r) > len(q) for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(end.get(p, [])))).encode()).hexdigest()
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids), leaves, saved, digest))
    return sorted(out, key=str)


def sample(seed, n=80):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c in (20, 43):
            continue  # no such conversation
        k = rng.choice([0, 1, 2, 3, 3, 6]) if c % 20 else 4
        for t in range(k):
            text = rng.choice(["hi", "hi there", "a b\x1cc  d", None, ""]) if t != 1 else "always the same"
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), text))
    rows += [(None, 1, "user", "nobody's"), (61, 3, "user", "x"), (61, 3, "user", "x"), (1000, 0, "user", "single")]
    rows += [(200 + i, t, "user", f"long {t}") for i in range(3) for t in range(60)]
    return rows


@pytest.mark.parametrize(("cap", "piece"), [(5000, 10_000), (1, 1), (3, 2), (10, 4)])
def test_equals_nested_dictionaries(spark, cap, piece):
    rows = sample(cap)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    got = trie.prefix_trie(trie.rebuilt(table), cap=cap, piece=piece)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(none)).count() == 0


def test_louds():
    # a root with two children, the first of which has three
    bits = trie.louds(np.array([2, 3, 0, 0, 0, 0]))
    assert "".join(str(int(b)) for b in bits) == "10" + "110" + "1110" + "0" * 4
    assert trie.parents(bits).tolist() == [-1, 0, 0, 1, 1, 1]
