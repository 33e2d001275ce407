"""Repeated word runs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from qaloom.llm import substrings
from qaloom.llm.common import scratch


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    order = [substrings.LAST_ID if d is None else d for d, _ in rows]
    least = {}
    for o, w in zip(order, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, o), o)
    out = []
    for o, w in zip(order, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < o:
                gone[i : i + window] = [True] * window
        spans = [i for i in range(len(w)) if gone[i] and not (i and gone[i - 1])]
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(spans)))
    return out


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['', 'é'])}w{i}" for i in range(400)]
    some = lambda n: rng.choices(vocabulary, k=n)
    shared = [some(n) for n in (12, 13, 14, 20, 26, 40, 90)]
    texts = []
    for _ in range(60):
        t = some(rng.randint(0, 60))
        for p in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, 3)
            t += p[a:] + some(rng.randint(0, 15))
        texts.append(rng.choice([" ", "\n\n", " \t", "\x0b"]).join(t))
    texts += [None, "", " \n ", "same " * 50, "same " * 50, texts[3], texts[3], "one\x1ctwo " * 14, "\x85 a\xa0b " * 20] + ["hot " + " ".join(shared[4])] * 30
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return [*rows, (None, texts[3]), (None, texts[3]), (rows[7][0], texts[3]), (-4, texts[5])]


@pytest.mark.parametrize(("window", "chunk", "piece"), [(13, 1 << 20, 1 << 22), (13, 90, 150), (4, 40, 60)])
def test_equals_brute_force(spark, window, chunk, piece):
    rows = sample(window + chunk)
    docs = spark.createDataFrame([(i, d, t, "x") for i, (d, t) in enumerate(rows)], "row int, doc_id long, text string, kept string").repartition(3)
    with scratch():
        got = substrings.remove_repeated_runs(docs, keep=["row", "kept"], window=window, chunk=chunk, piece=piece).orderBy("row").collect()
    assert [(r.n_words, r.n_removed, r.kept, len(r.spans)) for r in got] == brute(rows, window)
    assert all(r.kept_ == "x" and r.n_removed == sum(s.stop - s.start for s in r.spans) for r in got)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_words int")
    with scratch():
        assert substrings.remove_repeated_runs(none, keep=["doc_id", "n_words"]).count() == 0
        got = substrings.remove_repeated_runs(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, [], "")]


def test_packed_lists():
    import numpy as np

    v = np.sort(np.array([0, 5, 5, (1 << 64) - 1], np.uint64))
    w = np.array([3, -1, 7, 1 << 62], np.int64)
    a, b = substrings.unpacked(substrings.packed([v, w]), 2)
    assert a.tolist() == v.tolist() and b.tolist() == w.tolist()


def test_long_text_keeps_its_bound(spark):
    """A text of many pieces and a copy of its middle: what repeats goes, piece edges leave nothing out."""
    words = [f"t{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (0, " ".join(words[5_000:25_000]))]
    with scratch():
        got = substrings.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), piece=1000).orderBy("doc_id").select("n_removed", "spans", F.length("kept").alias("n")).collect()
    assert got[0].n_removed == 0 and got[1].n_removed == 20_000 and [tuple(s) for s in got[1].spans] == [(5_000, 25_000)]
