"""The near-duplicate stage of the pipeline against brute force on planted near copies."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import simhash, simhash_sets

pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def brute_kept(rows):
    """Positions of the rows that stay, ids first, then all columns; equal rows are one."""
    rows = list(dict.fromkeys(rows))
    sets = [brute_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= Fraction(4, 5):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return list(groups.values())


def planted():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 250))
        rows.append((n := n + 1, " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(1, len(copy) // 40 + 1)):  # scattered edits, some of them too many
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n := n + 1, " \n".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    return rows


def test_stage_keeps_one_of_each_group(spark):
    rows = planted()
    sets = [brute_set(t) for _, t in rows]
    near = [similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(Fraction(4, 5) <= s < Fraction(19, 20) for s in near) > 15 and sum(Fraction(1, 2) < s < Fraction(4, 5) for s in near) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(min(g) for g in brute_kept(rows))


def test_stage_on_odd_rows(spark):
    a, b = "one two three four five six seven", "quite other words that nobody has copied anywhere"
    rows = [(5, a), (5, b), (5, a), (9, a.upper()), (7, None), (3, " \n"), (None, "alone without an id"), (None, b), (8, "x y"), (4, "x  Y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.near_dedup(spark, docs, "").collect()
    got = {tuple(r) for r in out}
    assert len(out) == 5 and got == {(5, a), (5, b), (3, " \n"), (None, "alone without an id"), (4, "x  Y")}
    assert pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(1000):  # 180 of 220 hashes shared: 0.818
        s = rng.integers(0, 1 << 64, 220, np.uint64)
        x, y = np.sort(s[:200]), np.sort(s[20:])
        hits += bool((simhash_sets.band_keys(x) == simhash_sets.band_keys(y)).any())
        assert simhash_sets.alike(x, y)
    assert hits >= 999


def test_fingerprints_at_the_threshold():
    """Pairs at the least similarity lie within the radius; the bit-sliced masks count wide fingerprints exactly."""
    rng = np.random.default_rng(2)
    for n in (5, 9, 40, 220, 3000):
        far, fps = [], []
        for _ in range(300):
            s = rng.integers(0, 1 << 64, n * 11 // 9 + 1, np.uint64)
            k = -(-8 * len(s) // 10)  # the shared part of the union
            one, two = s[: k + (len(s) - k) // 2], np.concatenate([s[:k], s[k + (len(s) - k) // 2 :]])
            x, y = simhash_sets.set_fingerprint(one), simhash_sets.set_fingerprint(two)
            far.append(int(np.bitwise_count(x ^ y).sum()))
            fps.append(y)
        assert np.mean(np.array(far) <= simhash_sets.RADIUS) >= (0.99 if n < 40 else 1.0), n
    lanes = np.stack(fps[:64])
    q = lanes[:1] ^ np.array([[255, 1 << 63]], np.uint64)
    want = [int(np.bitwise_count(v ^ q[0]).sum()) <= 60 for v in lanes]
    live, mask = simhash.near_masks(simhash._planes(lanes), q, np.zeros(1, np.int64), 60)
    assert live.tolist() == [0] and [bool(int(mask[0]) >> i & 1) for i in range(64)] == want and 0 < sum(want) < 64


def test_last_step_finds_what_centres_miss(spark):
    """A chain of near copies: neighbours are alike, ends are not."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(5000)]
    base = rng.choices(words, k=200)
    rows = []
    for i in range(30):
        rows.append((i, " ".join(base)))
        for _ in range(3):
            base[rng.randrange(200)] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(min(g) for g in brute_kept(rows))


def test_repeated_ids_in_different_components(spark):
    rows = [(5, "one two three four five six seven"), (5, "quite other words that nobody has copied"), (6, "One two three four five six seven"), (5, "one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash_sets.one_per_group(docs).collect()) == sorted(rows[:2])


def templated(n, seed, shared=0.7):
    """``n`` pages that share most of their words in one place, and differ in the rest."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(50_000)]
    frame = rng.choices(words, k=int(140 * shared))
    return [(i, " ".join(frame + rng.choices(words, k=140 - len(frame)))) for i in range(n)]


def test_templates_go_through_finer_blocks(spark, monkeypatch):
    """With a small cap: pages of one template stay, near copies among them go, in blocks of rare shingles cut in chunks."""
    monkeypatch.setattr(simhash_sets, "CAP", 12)
    rng = random.Random(8)
    rows = templated(150, 8)
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in simhash_sets.one_per_group(docs).collect())
    assert got == sorted(min(g) for g in brute_kept(rows))


def test_ten_thousand_templated_texts(spark):
    """Nothing is a near copy, though all pages share 70 % of their words: within a minute, and none goes."""
    import time

    docs = spark.createDataFrame(templated(10_000, 3), "doc_id long, text string").repartition(8)
    began = time.time()
    assert simhash_sets.one_per_group(docs).count() == 10_000
    print(f"{time.time() - began:.0f} s")


def test_texts_of_large_blocks_are_sent_in_passes(spark, monkeypatch):
    """Chunk by chunk a text goes once for each chunk met: no pass sends many more than COPIES of all texts, and no link is lost."""
    monkeypatch.setattr(simhash_sets, "CAP", 16)
    rng = random.Random(9)
    rows = templated(150, 9)
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        rows.append((1000 + i, " ".join(w)))
    sent, dealt = [], simhash_sets._dealt
    monkeypatch.setattr(simhash_sets, "_dealt", lambda tiled, texts: sent.append((tiled.count(), texts.count())) or dealt(tiled, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in simhash_sets.one_per_group(docs).collect())
    assert got == sorted(min(g) for g in brute_kept(rows))
    assert sum(n for n, _ in sent) > 3 * sent[0][1] and max(n / texts for n, texts in sent) < 2 * simhash_sets.COPIES


def test_tiles_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Rows sent for one block are some times its members, not members times chunks; all members of different groups meet."""
    monkeypatch.setattr(simhash_sets, "CAP", 16)

    def tiles(n, others):
        own = [f"{i} as {c}" for i, c in enumerate(simhash_sets._OWN[1:])]
        node = spark.range(n).selectExpr("7L as key", f"if(id < {others}, id, {n}L) as root", "id as node", *own)
        first = simhash_sets._by_themselves(node, node.groupBy("key").agg(F.count("*").alias("n")))
        for rows, tile, sent in (first, simhash_sets._across(node, simhash_sets._sides(node))):
            dealt = {}
            for t, i, r in rows.select(F.explode(tile), "node", "root").collect():
                dealt.setdefault(t, []).append((i, r))
            assert abs(sum(map(len, dealt.values())) - sent) <= sent / 10 and max(map(len, dealt.values())) < 64
            yield sent, dealt

    (alone, chunks), (across, _) = tiles(1600, 10)
    assert alone <= 1.25 * 1600 and across <= 2.7 * 1600  # 100 chunks: each with each would be 160,000 rows
    assert len(set.intersection(*({i for i, _ in c} for c in chunks.values()))) > 0
    met = {(i, j) for c in list(tiles(200, 40))[1][1].values() for i, _ in c for j, _ in c}
    assert all((i, j) in met for i in range(40) for j in range(200) if i != j)
