"""Near-duplicate components and repeated spans against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qaloom.llm import common, simhash, suffix_dedup


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c == " " or 9 <= ord(c) <= 13:
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in ("", None, " \t\n", "One", "A b C", "a b c d", "Ünïcode É x y z a b\x0bc", "a b c d " * 50, " x y z w v"):
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t), t
    long = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == brute_fingerprint(long)


@pytest.mark.parametrize("cap", [2, 4096])
def test_links_are_exact(spark, cap):
    rng = random.Random(cap)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for b in base for _ in range(12)} | {0, 1, 7, 255})
    nodes = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.root for r in common.connected(simhash.link_fingerprints(nodes, 4, cap)).collect()}
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    want = brute_components(fps)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_masks_count_exactly():
    rng = np.random.default_rng(3)
    q = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    lanes = q ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in list(range(32)) * 2], np.uint64)
    live, mask = simhash.near_masks(simhash._planes(lanes), q, np.zeros(1, np.int64))
    bits = [int(mask[0]) >> i & 1 for i in range(64)]
    assert live.tolist() == [0] and bits == [int((int(q[0]) ^ int(x)).bit_count() <= 4) for x in lanes]


ROWS = [(5, "the quick brown fox jumps over it"), (2, "The QUICK brown fox jumps over it"), (2, "The QUICK brown fox jumps over it"), (9, None), (7, ""), (None, "\n"), (4, "something else entirely here now"), (None, "lonely row without an id at all")]


def test_components_of_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in ROWS]
    roots = brute_components(fps)
    low = {}
    for (i, _), r in zip(ROWS, roots):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    assert got == sorted(((i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(ROWS, fps, roots)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_star_of_fingerprints(spark):
    """A hub with many neighbours: its group is split, and all of it is one component."""
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    nodes = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in flips], "fp long")
    roots = common.connected(simhash.link_fingerprints(nodes, 4, 1024)).collect()
    assert len(roots) == len(flips) and len({r.root for r in roots}) == 1
    spokes = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert common.connected(spokes).agg(F.count("*"), F.max("root")).first()[:] == (100_001, 0)


def test_scratch_is_emptied(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    folder = common.shared_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    before = files()
    out = simhash.near_duplicates(df)
    left = files() - before
    assert len({os.path.dirname(f) for f in left}) <= 1 and len(out.collect()) == len(ROWS)


def brute_repeats(texts, window):
    c = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if c[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if len(t) else b""
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_exact(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdéf \n") for _ in range(n))
    shared = [word(rng.randint(30, 120)) for _ in range(6)]
    texts = []
    for _ in range(30):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            t += word(rng.randint(0, 60)) + p[a : a + rng.randint(10, 110)] + "a" * (rng.random() < 0.2) * rng.randint(1, 100) + "xyz" * (rng.random() < 0.2) * rng.randint(1, 40)
        texts.append(t)
    texts += [texts[3], None, "", shared[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("cells", F.lit(1)).repartition(3)
    with common.scratch():
        rows = suffix_dedup.remove_repeats(df, window=40, gram=10, widths=(7, 2, 1))
        got = [tuple(r)[1:] for r in rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("doc_id").collect()]
    assert got == brute_repeats([(t or "").encode() for t in texts], 40)


def test_repeats_in_long_and_odd_rows(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (1, "x" * 399), (2, "y" * 401), (None, long[1000:1500] + "é"), (3, long[262_000:262_500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with common.scratch():
        out = suffix_dedup.remove_repeats(df, as_text=True)
        got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in out.collect()}
    assert got == {(1, 700_000): (1000, 2), (1, 399): (0, 0), (2, 401): (401, 1), (None, 502): (500, 1), (3, 500): (500, 1)}
    with common.scratch():
        assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_in_one_long_character_run(spark):
    df = spark.createDataFrame([(1, "a" * 1_000_000), (2, "b" * 300 + "a" * 399)], "doc_id long, text string")
    with common.scratch():
        got = sorted((r.doc_id, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(1, 1_000_000, 1, b""), (2, 0, 0, b"b" * 300 + b"a" * 399)]


def test_anchors_go_before_the_passes(spark, monkeypatch):
    """Besides the texts only the active cells lie in the shared folder when a pass begins, and no wide table when it ends."""
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    wide = lambda: sum(f.startswith("staged-") for f in set(os.listdir(folder)) - before)
    seen, refine = [], suffix_dedup._refine

    def spied(texts, active, units, step, parts):
        first = wide()
        out = refine(texts, active, units, step, parts)
        seen.append((step, first, wide()))
        return out

    monkeypatch.setattr(suffix_dedup, "_refine", spied)
    df = spark.createDataFrame([(i, f"{i} " * 40 + "shared passage " * 60) for i in range(8)], "doc_id long, text string")
    with common.scratch():
        removed = [r.n_removed for r in suffix_dedup.remove_repeats(df, words=50).collect()]
    assert min(removed) >= 900 and seen == [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
