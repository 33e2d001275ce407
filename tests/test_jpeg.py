"""JPEG files read back with the Java runtime's decoder."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.functions import jpeg


def smooth(h, w, channels=1):
    y, x = np.mgrid[0:h, 0:w]
    planes = [127 + 100 * np.sin(x / (7 + c)) * np.cos(y / (9 + 2 * c)) for c in range(channels)]
    return np.rint(np.stack(planes, 2)[:, :, 0] if channels == 1 else np.stack(planes, 2))


def test_files_decode(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {
        "gray": smooth(64, 48), "odd": smooth(37, 51), "colour": smooth(40, 33, 3), "flat": np.full((8, 8), 255), "dot": np.zeros((1, 1)), "sparse": np.zeros((24, 24)),
        "noise": rng.integers(0, 256, (50, 41, 3)), "checks": np.indices((16, 16)).sum(0) % 2 * 255,
    }
    images["sparse"][3, 4] = 255
    for quality in (75, 100):
        at = tmp_path / str(quality)
        at.mkdir()
        for name, x in images.items():
            (at / f"{name}.jpg").write_bytes(jpeg.encode(x, quality))
        rows = spark.read.format("image").load(str(at)).select("image.*").collect()
        assert len(rows) == len(images)
        for r in rows:
            want = images[r.origin.rsplit("/", 1)[1][:-4]]
            got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, ::-1].astype(float)
            assert got.shape[:2] == want.shape[:2] and (r.nChannels == 3) == (want.ndim == 3)
            error = np.sqrt(np.mean((got.reshape(want.shape) - want) ** 2))
            assert error < (2 if quality == 100 else 50 if "noise" in r.origin else 15), (r.origin, quality, error)


def test_columns(spark):
    x = smooth(9, 10, 3)
    d = spark.createDataFrame([(1, x.reshape(-1).tolist(), 9, 10), (2, None, 9, 10), (3, [1.0], None, 1)], "i int, p array<double>, h int, w int")
    got = {r.i: r.j for r in d.select("i", jpeg.jpeg("p", "h", "w").alias("j")).collect()}
    assert bytes(got[1]) == jpeg.encode(x) and got[2] is None and got[3] is None
    assert d.limit(0).select(jpeg.jpeg("p", "h", "w")).count() == 0
    for bad in (np.zeros((0, 3)), np.zeros((2, 2, 2)), np.zeros(4)):
        with pytest.raises(ValueError):
            jpeg.encode(bad)


def test_code_lengths_are_shortest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 200):
        counts = np.zeros(256, int)
        counts[:n] = rng.integers(1, 1000, n)
        got = jpeg.code_lengths(counts)
        heap, total = [0, *counts[:n].tolist()], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert sum(counts[s] * k for s, k in got.items() if s >= 0) == total and got[-1] == max(got.values()) <= jpeg.LONGEST
    steep = np.zeros(256, int)
    steep[:40] = 2 ** np.arange(40)
    got = jpeg.code_lengths(steep)
    assert max(got.values()) == jpeg.LONGEST and sum(2.0**-k for k in got.values()) <= 1
