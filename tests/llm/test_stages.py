"""Three stages of the pipeline against plain versions: line rules, classifier, packing."""

import re
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from qaloom.llm import gam
from qaloom.llm.queries import tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = [
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe now",
    "subscribe to", "lorem ipsum", "enable javascript", "licensed under", "sign up for", "follow us on", "share this",
]


def line_fails(line):
    n = len(WORD.findall(line))
    bars = sum(line.count(c) for c in "|»•·")
    symbols, runs = sum(line.count(c) for c in "#*$%&<>"), len(re.findall(r"[#*$%&<>]{2,}", line))
    shouts = len(re.findall("!!", line))
    ended = re.search(r"""[.!?…:;"”’»)\]][\x20\x09-\x0D]*$""", line)
    return n > 0 and bool(
        (n <= 5 and not ended) or (bars >= 3 and 4 * bars >= n) or (symbols >= 6 and runs >= 3 and 5 * runs >= n)
        or (shouts >= 3 and 5 * shouts >= n) or any(p in line.lower() for p in PHRASES)
    )


def rules(text):
    """The text that is left, or None."""
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    rest = "\n".join(x for x in text.split("\n") if not line_fails(x))
    solid = lambda t: sum(map(len, WORD.findall(t)))
    if len(words) < 10 or 100 * len(again) > 20 * len(words) or solid(text) - solid(rest) > solid(text) / 2:
        return None
    return rest


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = [(-1, None), (-2, ""), (-3, "a b c d e f g h i j k.\n" * 2), (-4, "One line is long enough to stay in the text as it is.\nHome | News | About | Contact\nshort\nAnother line of many plain words stays, too."), (None, "Words enough to be a document of its own, so it stays here.")]
    real = spark.read.parquet(f"{sf}/documents.parquet")
    return real.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).repartition(3).checkpoint()


def test_quality_rules(spark, sf, docs):
    got = sorted(((r.doc_id, r.text) for r in pipeline.quality_rules(spark, docs, sf).collect()), key=str)
    want = [(r.doc_id, rules(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted((x for x in want if x[1] is not None), key=str) and 0 < len(got) < len(want)


def test_quality_classifier(spark, sf, docs):
    docs = docs.withColumn("__copy", F.lit("mine")).withColumn("__score", F.lit(2.0))
    out = pipeline.quality_classifier(spark, docs, sf)
    assert out.columns == docs.columns and {(r["__copy"], r["__score"]) for r in out.collect()} == {("mine", 2.0)}
    model = gam.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    squeeze = zstandard.ZstdCompressor(level=1)

    def score(text):
        import numpy as np

        x = gam.features((text or "").encode(), squeeze)
        z = model.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, x))
        z += sum(t[np.searchsorted(model.coarse[i], x[i], "right"), np.searchsorted(model.coarse[j], x[j], "right")] for (i, j), t in zip(model.pairs, model.pair_tables))
        return 1 / (1 + np.exp(-z))

    want = [r.doc_id for r in docs.select("doc_id", "text").collect() if score(r.text) >= 0.3]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)


def test_best_fit_packing(spark, sf, docs):
    from zlib import crc32

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    # ids may be null or repeat: pieces are compared as a bag
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, p, at, len(part), crc32(np.array(part, "<u4").tobytes())))
    got = pipeline.packing(spark, docs, sf).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048
    # plain best fit over all pieces at once needs no fewer sequences, but for one in fifty
    room = []
    for n in sorted((w[3] for w in want), reverse=True):
        fits = [i for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(2048 - n)
    assert len(bins) <= len(room) * 1.02 + 1
