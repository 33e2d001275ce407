"""Packing, sharding, quality, tokens and SentencePiece on edge rows, against plain versions."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.llm import gam, line_quality, packing, sharding, spm, token_counts, wordcache
from qaloom.llm.queries import tokenizer

ODD = [(1, "One two, three. <|endoftext|> it's"), (1, "One two, three. <|endoftext|> it's"), (2, None), (3, ""), (None, "Ünïcode ÉÀ ſ İi Σας ½ 1234 a.b,c \x1c\x85  z"), (4, "w " * 9000), (5, "\U0001f600" * 30 + "\n\t\r\x0b\x0c x_y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("score", F.lit(1))


def test_pieces_and_packing(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = packing.pack(packing.tokenize_pieces(odd, tokenizer("word_bpe_49k.json")), part=4).collect()
    want = []
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.append((i, k, at, ids[at : at + 2048]))
    got = [(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= 2048
    assert packing.pack(packing.tokenize_pieces(odd.limit(0), tokenizer("word_bpe_49k.json"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_bounds_hold(lengths):
    x = np.array(lengths, np.int64)
    bins, offset, free = packing.best_fit_decreasing(x, 64)
    assert packing.lower_bound(np.bincount(x, minlength=65), 64) <= len(free)
    for b in range(len(free)):
        assert x[bins == b].sum() + free[b] == 64


def test_bound_certifies_big_items():
    assert packing.lower_bound(np.bincount([40] * 7, minlength=65), 64) == 7


def test_exchange_saves_sequences(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(n),) for n in rng.integers(300, 1500, 600)], "length long")
    told = []
    n = packing.pack(df, part=20, report=told.append).select("sequence_id").distinct().count()
    assert n <= told[0]["sequences"] and told[0]["released"] > 0


def test_word_tokenizer_parity():
    import random

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok, enc, rng = Tokenizer.from_file(path), wordcache.SpacedBpe(path, packing.WORD_PIECES, cap=50), random.Random(0)
    alphabet = " \n\t\x1c\x85\xa0abCDéÉßµªº²½019.,;!?'’\"|<>_-ΣσςİǰJ̌́…日本語<|endoftext|>it's we'RE"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_tokenizer_parity_on_documents(sf):
    """All of sf0.01, ids by the library, text by text."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    texts = [t or "" for t in pq.read_table(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in wordcache.SpacedBpe(path, packing.WORD_PIECES).encode(texts)] == want
    merges = wordcache.WordMerges({"a</w>": 0}, [], "</w>")
    with pytest.raises(ValueError):
        merges.encode(b"b")


def test_kept_names_that_clash(spark, odd):
    df = odd.withColumns({c: F.lit("mine") for c in ("piece", "offset", "sequence_id", "field", "section", "out")})
    rows = packing.pack(packing.tokenize_pieces(df, tokenizer("word_bpe_49k.json"), keep=["doc_id", "piece", "offset", "sequence_id"])).collect()
    assert {(r.piece_, r.offset_, r.sequence_id_) for r in rows} == {("mine",) * 3} and {r.offset for r in rows} > {0}
    rows = token_counts.section_counts(df, tokenizer("byte_bpe_50k.tiktoken"), [], keep=["doc_id", "field", "section"]).collect()
    assert {(r.field, r.field_, r.section_) for r in rows} == {("text", "mine", "mine")}
    assert {r.out_ for r in spm.encode(df, tokenizer("piece_bpe_32k.model"), keep=["out"], out="out").collect()} == {"mine"}


def test_sharding(spark, odd):
    r = sharding.shard_rows(odd, shards=3).collect()
    assert sorted(x.position for x in r) == list(range(len(ODD)))
    assert all(sharding.place_of(x.row_number, len(ODD), 3) == (x.shard, x.slot) for x in r)
    assert {(x.doc_id, x.size, x.text_crc32) for x in r} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD}
    assert sharding.shard_rows(odd.limit(0)).count() == 0
    for n in (1, 2, 3, 5, 10, 37):
        p = spark.range(n).select(sharding.permute(F.col("id"), n).alias("p")).collect()
        assert sorted(x.p for x in p) == list(range(n))
    again = {(x.row_number, x.shard, x.slot) for x in sharding.shard_rows(odd.repartition(5), shards=3).collect()}
    assert again == {(x.row_number, x.shard, x.slot) for x in r}


def brute_repeat_words(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(hit)


def test_line_quality(spark):
    texts = [None, "", " \n", "a b c d e f g h i j k. ", "x y z u v w x y z u v w a b c.", "a a a a a a a a a a a.", "Home | About | Blog | More |\n" + "Good words stand here in a row for all to read now.", "Same line here.\nSame line here.\nother words come now and then again too.", "#1 *&% <b>\x0b|| $ one two three four five six seven eight nine"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    got = {r.doc_id: r for r in line_quality.measure(df).collect()}
    import re

    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        rep = brute_repeat_words(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep), i
        assert r.base_failed == (len(w) < 10 or 100 * rep > 20 * len(w))
    assert got[6].clean_text == texts[6].split("\n")[1] and got[6].kept
    kept = line_quality.clean_documents(df)
    assert kept.columns == df.columns and {(r.kept, r.n_words) for r in kept.collect()} == {("mine", "mine")}
    assert line_quality.clean_documents(df.limit(0)).count() == 0


def brute_features(t, squeeze):
    import re

    raw = t.encode()
    w = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw)
    if not w:
        return [0.0] * len(gam.FEATURES)
    n, lines = len(raw), [x.rstrip() for x in raw.split(b"\n") if x.strip()]
    share = lambda ok: sum(map(ok, raw)) / n
    return [
        float(np.log1p(len(w))), sum(map(len, w)) / len(w), share(lambda c: c in b"#*$%&|<>"), share(lambda c: c == 33), share(lambda c: 65 <= c <= 90),
        share(lambda c: 48 <= c <= 57), share(lambda c: c > 127), len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w),
        sum(c in b".," for c in raw) / len(w), len(w) / len(lines), sum(x[-1] in b".!?" for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        len(squeeze.compress(raw)) / n, float(max(map(len, w))),
    ]


def test_training_rows_are_bounded_before_the_driver(spark, monkeypatch):
    """One labelled id that 50,000 rows repeat, among 300 others: a row an id, and no more than asked for."""
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same id, text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.range(1000, 1300).select("id", F.concat(F.lit("other "), F.col("id").cast("string"))))
    labels = spark.range(1300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    plain = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: seen.append(plain(self)) or seen[-1])
    gam.fit(docs, labels, max_train=20_000)
    gam.fit(docs, labels, max_train=60)
    assert [len(x) <= n and not x.doc_id.duplicated().any() for x, n in zip(seen, (301, 60))] == [True, True] and 7 in set(seen[0].doc_id)


def test_gam(spark, odd, sf):
    docs, labels = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    model = gam.fit(docs, labels)
    got = gam.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and (good >= gam.THRESHOLD).mean() > 0.95
    scored = gam.score(odd, model, keep=["doc_id", "score"], out="__s").collect()
    assert len(scored) == len(ODD) and all(0 <= r["__s"] <= 1 for r in scored)
    # scores and features against plain versions: look-ups one by one
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 200").collect()}
    plain = {r.doc_id: r.score for r in gam.score(docs.where("doc_id < 200"), model).collect()}
    for i, t in texts.items():
        x = brute_features(t or "", squeeze)
        z = model.base + sum(table[sum(v >= e for e in edges)] for v, edges, table in zip(x, model.edges, model.tables))
        z += sum(table[sum(x[a] >= e for e in model.coarse[a])][sum(x[b] >= e for e in model.coarse[b])] for (a, b), table in zip(model.pairs, model.pair_tables))
        assert abs(plain[i] - 1 / (1 + np.exp(-z))) < 1e-9, i
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    a, b = gam.fit(twice, labels, max_train=50), gam.fit(twice.repartition(7), labels, max_train=50)
    assert a.base == b.base and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))
    none = gam.fit(odd, labels.limit(0))
    assert gam.score(odd, none).first().score == 0.5
    one = gam.fit(docs, labels.where("quality = 1"))
    assert gam.score(odd, one).first().score > 0.9
    x = np.random.default_rng(0).normal(size=(400, len(gam.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = gam.train(x, y)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.85 and (0, 1) in m.pairs


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    df = odd.withColumn("lang", F.lit("en")).withColumn("field", F.lit(None).cast("string"))
    rows = token_counts.section_counts(df, tokenizer("byte_bpe_50k.tiktoken"), ["lang", "field"]).toPandas()
    for i, t in {i: t for i, t in ODD if i != 1}.items():
        text = "en\n\n" + (t or "")
        tok.encode_special_tokens = True
        spans = tok.encode(text, add_special_tokens=False).offsets
        r = rows[rows.doc_id.isna() if i is None else rows.doc_id == i].sort_values(["char_start", "char_end"])
        assert r.n_tokens.sum() == len(spans) and r.char_end.max() == len(text), i
        starts = r.char_start.to_numpy()
        want = np.bincount(np.searchsorted(starts, [a for a, _ in spans], "right") - 1, minlength=len(starts))
        assert want.tolist() == r.n_tokens.tolist(), i
    n, crossing = token_counts.attribute(np.array([0, 3]), np.array([3, 9]), np.array([0, 4]), "most")
    assert (n.tolist(), crossing.tolist()) == ([1, 1], [0, 1])
    n, _ = token_counts.attribute(np.array([0, 3]), np.array([3, 9]), np.array([0, 4]), "last")
    assert n.tolist() == [1, 1]
    with pytest.raises(ValueError):
        token_counts.section_counts(df, "x", [], rule="none")


def test_sentencepiece_parity(spark, odd):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spm.encode(odd, path).collect()
    want = {(i, tuple(sp.encode(t or ""))) for i, t in ODD}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows} == want
    back = spm.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids binary"), path).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(i, t or "") for i, t in ODD}
    assert spm.encode(odd.limit(0), path).count() == 0
    codec = spm.codec(path)
    for t in ("  lead", "trail  ", "a  b", "▁mark", "new\nline", "<s> </s> <0x0A>", "日本 é́"):
        ids = next(iter(codec.encode([t])))
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and codec.decode(ids) == sp.decode(sp.encode(t)), t


def test_sentencepiece_unigram_model():
    """A model of the other kind, written here, agrees with the reference library."""
    import struct

    import sentencepiece

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + (bytes([len(body)]) + body if wire == 2 else body)

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("a", -2.5, 1), ("▁ab", -1.2, 1)]
    buf = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    pieces.append(("bab", 0.0, 4))
    buf += field(1, 2, field(1, 2, b"bab") + field(2, 5, struct.pack("<f", 0.0)) + field(3, 0, b"\x04"))
    buf += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    sp = sentencepiece.SentencePieceProcessor(model_proto=buf)
    m = spm.parse_model(buf)
    assert (m.kind, len(m.pieces), m.remove_extra_whitespaces) == (spm.UNIGRAM, 8, True)
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(buf)
        f.flush()
        codec = spm.Codec(f.name, 1)
        for t in ("ab", "a ab  b", "abab aab", "b", "", "abab", "bab", "aababb babbab"):
            assert np.frombuffer(next(iter(codec.encode([t]))), "<u4").tolist() == sp.encode(t), t
