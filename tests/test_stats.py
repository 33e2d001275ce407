"""Quantiles by selection and truncated kernels against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.operators import stats


@pytest.mark.parametrize(("most", "parts"), [(10_000, 128), (20, 8)])
def test_quantiles(spark, most, parts):
    rng = random.Random(most)
    groups = {
        "even": [rng.random() for _ in range(300)], "wild": [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(200)], "one": [4.5],
        "same": [2.0] * 90, "hot": [1.0] * 80 + [rng.gauss(0, 1) for _ in range(40)], None: [3.0, 1.0, None, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in stats.quantiles(df, ["k"], "v", shares, most, parts).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile([v for v in vs if v is not None], shares), rtol=1e-9), k


def test_summary_of_doubles(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5), ("b", None), (None, 7.0)], "k string, v double")
    got = {r.k: r for r in stats.summary(df, "v", ["k"]).collect()}
    assert got["a"].median == 2.0 and got["b"].median is None and got["b"]["count"] == 0 and got[None].median == 7.0
    assert stats.summary(df, "v").first().median == 2.5 and stats.summary(df.limit(0), "v").first()["count"] == 0


def test_many_distinct_doubles_of_one_group(spark):
    """Half a million distinct doubles in one group: the exact median, and no task that puts more than ``MOST`` in order."""
    n = 500_001
    df = spark.range(n).select(F.lit("g").alias("k"), F.sqrt(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")).alias("v"))
    q = stats.quantiles(df, ["k"], "v", [0.5, 0.9]).first().q
    assert q[0] == math.sqrt(250_000) and abs(q[1] - math.sqrt(450_000)) < 1e-9


def test_kernels(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(50, 20) for _ in range(300)] + [5000.0], "b": [3.0], "c": [1.0, 1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = stats.kde(df, "k", "v", points=50).orderBy("k", "i").collect()
    assert len(got) == 150
    for k, vs in groups.items():
        sd, n = np.std(vs), len(vs)
        h = 0.4 if sd == 0 else max(0.2, 1.06 * sd * n**-0.2)
        grid = np.linspace(min(vs), max(vs), 50)
        want = [sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in vs) / (n * h * 2.5066282746310002) for x in grid]
        assert np.allclose([r.density for r in got if r.k == k], want, atol=1e-12)
