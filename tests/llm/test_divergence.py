"""The source audit against a plain evaluation of every pair and term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from qaloom.llm import divergence


def brute(rows, least, top):
    groups, docs, n = set(), Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs.update({(lang, w) for w in words})
        n[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [w for (x, w), c in docs.items() if x == lang and c >= least]
        mates = [s for x, s in groups if x == lang]
        counts = {s: [n[lang, s][w] for w in kept] for s in mates}
        counts[None] = [sum(c) for c in zip(*counts.values())]
        p = {s: [1 + 10**9 * (c + 5) // (sum(v) + 5 * len(kept)) for c in v] for s, v in counts.items()}
        pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[source], p[s])), s.encode()) for s in mates if s != source))
        terms = sorted((q - a, w.encode()) for w, c, a, q in zip(kept, counts[source], p[source], p[None]) if c and a > q)[:top]
        for part, items in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, x.decode(), -v, i) for i, (v, x) in enumerate(items, 1)]
    return sorted(out)


def sample(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "É", "ß", "日"]) + rng.choice("abCDe") * rng.randint(1, 3) + rng.choice(["", "x", "ÿ", "\x7f"]) for _ in range(60)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["hot", "hot", "b", "é", None, f"s{i % 7}"]), rng.choice([" ", "1", "_", "\n", "@["]).join(words)))
    rows += [("xx", "a", None), ("xx", "b", ""), ("xx", "c", "Once only"), ("en", "blank", " 12 "), ("en", "long", "word Word " * 400)]
    return rows + rows[:3]


@pytest.mark.parametrize(("least", "top", "options"), [(4, 50, {}), (2, 3, {"chunk": 300, "shard": 3, "tile": 10}), (9, 5, {"chunk": 7, "tile": 1})])
def test_equals_plain_evaluation(spark, least, top, options):
    rows = sample(least)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, item string").repartition(3)
    got = divergence.audit(docs, least_docs=least, top=top, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    import numpy as np

    n, below = np.array([10**13 + 7, 3], np.int64), np.array([10**15 + 1, 10**15 + 1], np.int64)
    want = [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(n, below)]
    assert divergence._shares(n, below).tolist() == want
    rows = spark.createDataFrame([(int(a), int(b) - 5 * 10**6, 10**6) for a, b in zip(n, below)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want
