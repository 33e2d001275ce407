"""The repeated-span stage of the pipeline against brute force on planted passages of 45 to 60 words."""

import random
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(texts, words=50, window=400):
    """Every text without the words and bytes of its repeated runs and windows, all judged on the input."""
    raw = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in raw]
    runs = [[tuple(t[a:b] for a, b in s[i : i + words]) for i in range(len(s) - words + 1)] for t, s in zip(raw, spans)]
    wins = [[t[i : i + window] for i in range(len(t) - window + 1)] for t in raw]
    n_run, n_win = Counter(x for r in runs for x in r), Counter(x for w in wins for x in w)
    out = []
    for t, s, r, w in zip(raw, spans, runs, wins):
        gone = [False] * len(t)
        for i, x in enumerate(r):
            if n_run[x] > 1:
                a, b = s[i][0], s[i + words - 1][1]
                gone[a:b] = [True] * (b - a)
        for i, x in enumerate(w):
            if n_win[x] > 1:
                gone[i : i + window] = [True] * window
        out.append(bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stage_cuts_short_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"{rng.choice(['', 'é'])}{rng.choice('abcdefgh')}{i}" for i in range(900)]
    some = lambda n: rng.choices(vocabulary, k=n)
    shared = [some(n) for n in (45, 49, 50, 51, 53, 57, 60, 140)]
    texts = []
    for i in range(40):
        t = some(rng.randint(0, 80))
        for p in rng.sample(shared, rng.randint(0, 3)):
            t += p + some(rng.randint(0, 30))
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    texts += ["tick " * 60, None, "", "l" * 450 + " one", "two " + "l" * 450, " ".join(shared[3] + shared[4] + shared[3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.text for r in pipeline.repeated_spans(spark, docs, "").orderBy("doc_id").collect()]
    want = brute_kept(texts)
    assert got == want
    cut = [i for i in range(40) if " ".join(shared[4]) in " ".join((texts[i] or "").split())]
    assert len(cut) > 1 and all(" ".join(shared[4][5:]) not in " ".join(got[i].split()) for i in cut)
