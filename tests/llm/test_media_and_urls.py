"""Telephony codecs and URL judgments."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import linkgraph, telephony
from qaloom.llm.queries import QUERIES, URL_RULES


def test_tables_by_the_standard():
    """Expansion by the textbook rule of G.711, code by code."""
    for code in range(256):
        u = code ^ 0xFF
        t = ((u & 0x0F) << 3) + 0x84
        t <<= (u & 0x70) >> 4
        assert telephony.MULAW[code] == (0x84 - t if u & 0x80 else t - 0x84)
        a = code ^ 0x55
        t, seg = (a & 0x0F) << 4, (a & 0x70) >> 4
        t += 8 if seg == 0 else 0x108
        t = t << (seg - 1) if seg > 1 else t
        assert telephony.ALAW[code] == (t if a & 0x80 else -t)


def slow_adpcm(data, predictor=0, index=0):
    out = []
    for byte in data:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            predictor = max(-32768, min(32767, predictor - d if n & 8 else predictor + d))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[n])))
            out.append(predictor)
    return out


@pytest.mark.parametrize("codec", list(telephony.TAGS))
def test_files_hold_payloads(codec):
    r = np.random.default_rng(0)
    payloads = [r.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 3, 40)]
    got = telephony.read_many([telephony.write_wav(codec, p) for p in payloads])
    assert [(c, p) for c, _, p, _ in got] == [(codec, p) for p in payloads]
    if codec == "adpcm":
        size = telephony.ADPCM_BLOCK - 4
        for p, (*_, pcm) in zip(payloads, got):
            want = [s for at in range(0, len(p), size) for s in [0, *slow_adpcm(p[at : at + size])]]
            assert pcm.tolist() == want


def test_files_of_others(spark):
    """Nulls, files without a fact chunk, a header state that is not zero, and a kept column that clashes."""
    import struct

    def wav(fmt, data, fact=None):
        chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + bytes(len(b) & 1)
        body = b"WAVE" + chunk(b"fmt ", fmt) + (chunk(b"fact", struct.pack("<I", fact)) if fact is not None else b"") + chunk(b"data", data)
        return b"RIFF" + struct.pack("<I", len(body)) + body

    plain = wav(struct.pack("<HHIIHH", 7, 1, 8000, 8000, 1, 8), b"abc")
    blocks = struct.pack("<hBB", -500, 9, 0) + bytes(range(60))
    adpcm = wav(struct.pack("<HHIIHHHH", 17, 1, 8000, 4055, 64, 4, 2, 121), blocks, 1 + 2 * 50)
    (_, _, p, pcm), (_, _, q, heard) = telephony.read_many([plain, adpcm])
    assert p == b"abc" and pcm.tolist() == telephony.MULAW[list(b"abc")].tolist()
    assert q == bytes(range(50)) and heard.tolist() == [-500, *slow_adpcm(bytes(range(50)), -500, 9)]
    df = spark.createDataFrame([(1, None, "alaw", "m"), (2, b"xy", None, "m"), (3, b"xy", "alaw", "m")], "id int, p binary, c string, media string")
    stored = telephony.store_payloads(df, "p", "c", ["id", "media"])
    assert [(r.id, r.media is None, r.media_) for r in stored.orderBy("id").collect()] == [(1, True, "m"), (2, True, "m"), (3, False, "m")]
    back = telephony.decode_media(stored, "media", ["id"]).orderBy("id").collect()
    assert [(r.codec, r.payload) for r in back] == [(None, None), (None, None), ("alaw", b"xy")]


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert telephony.resample(x, 8000, 8000).tolist() == x.tolist()
    assert len(telephony.resample(np.zeros(80, np.int16), 8000, 11025)) == 110
    assert telephony.features(np.zeros(0, np.int16), 8000).startswith("ms=0;power=0;peak=0;cross=0")


def test_media_query_columns(spark, tmp_path):
    texts = [(1, "Grüße"), (2, None), (3, ""), (4, "x" * 64), (4, "x" * 64), (None, "z" * 5000)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("payload", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op8_telephony_media"](spark, str(tmp_path)).collect()
    want = []
    for i, t in texts:
        b = (t or "").encode()
        p = b + bytes(64 if not b else -len(b) % 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, want))
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 4}) == 1
    assert all(r.media_bytes > r.payload_bytes for r in rows)


URLS = [
    ("http://A.Net/x?y", "a.net", "/x", "net/", "block"), ("https://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"), ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://a.net", "a.net", "", None, None), ("plain", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("http://h?://x", "h", "", None, None), ("", "", "", None, "allow"), ("://H/p", "h", "/p", None, None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {r.page_id: r for r in linkgraph.judge_urls(df, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert verdict is None or got[i].verdict == verdict, i
    assert linkgraph.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_distrust_flows_backwards(spark):
    pages = [(1, "http://bad.net/", ""), (2, "http://mid.com/", '<a href="http://BAD.net/q">'), (3, "http://far.com/", "<a href='//mid.com/'>"), (4, "http://good.org/fr/", '<a href="http://fine.com/">'), (5, "http://fine.com/", None), (6, "http://other.com/", "<a href='/local'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in linkgraph.judge_urls(df, URL_RULES).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert got[2].distrust > got[3].distrust > 0 and got[5].trust > 0


def test_propagation_equals_power_iteration(spark):
    rng = np.random.default_rng(5)
    n = 12
    a = (rng.random((n, n)) < 0.25) * rng.integers(1, 5, (n, n)) * (1 - np.eye(n))
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "src string, dst string, n double")
    seeds = spark.createDataFrame([("h0", 3.0), ("h5", 1.0)], "host string, weight double")
    got = {r.host: r["rank"] for r in linkgraph.propagate(seeds, edges, rounds=15, settled=0).collect()}
    s = np.zeros(n)
    s[0], s[5] = 0.75, 0.25
    out = a.sum(1)
    m = np.divide(a, out[:, None], where=out[:, None] > 0, out=np.zeros_like(a))
    p = 0.15 * s
    for _ in range(15):
        p = 0.15 * s + 0.85 * (p @ m)
    assert all(abs(p[i] - got.get(f"h{i}", 0.0)) < 1e-9 for i in range(n))


def test_walk_settles_or_raises(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("a", 2.0)], "host string, weight double")
    got = {r.host: r["rank"] for r in linkgraph.propagate(seeds, edges).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1e-6 and abs(got["b"] - 0.85 * got["a"]) < 1e-6
    with pytest.raises(RuntimeError):
        linkgraph.propagate(seeds, edges, rounds=12)


def test_query_equals_sql_on_a_linked_graph(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(9)
    hosts = [f"h{i}.{d}" for i, d in enumerate(["net", "com", "org", "example.net", "example.com", "com", "com", "org"])]
    pages = []
    for i in range(60):
        html = "".join(f'<a href="https://{hosts[int(j)]}/x">' for j in rng.integers(0, len(hosts), 3))
        pages.append((i, f"http://{hosts[i % len(hosts)]}/{['en', 'fr', 'de'][i % 3]}/{i}", html))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    from qaloom.llm.queries import ORACLE

    got = QUERIES["op9_url_linkgraph"](spark, str(tmp_path)).toPandas().sort_values("page_id", ignore_index=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(ORACLE["op9_url_linkgraph"]).df().sort_values("page_id", ignore_index=True)
    assert {"block", "allow"} == set(got.verdict) and got.distrust.nunique() > 3
    for c in ("host", "path", "verdict"):
        assert got[c].tolist() == want[c].tolist(), c
    assert np.allclose(got.trust, want.trust, atol=2e-5) and np.allclose(got.distrust, want.distrust, atol=2e-5)
