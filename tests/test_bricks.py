"""Views, orientation and bricks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.functions import arrays
from qaloom.operators import bricks, volume


def rows(spark, *volumes):
    data = [(i, list(v.shape), v.reshape(-1).tolist()) for i, v in enumerate(volumes)]
    return spark.createDataFrame(data, "case_id int, shape array<int>, data array<double>")


def back(df, edge):
    """Volumes from voxel rows."""
    out = {}
    for r in bricks.voxels(df, ["case_id"], edge).collect():
        out.setdefault(r.case_id, {})[r.z, r.y, r.x] = r.value
    return {k: np.array([v[p] for p in sorted(v)]).reshape([max(p[a] for p in v) + 1 for a in range(3)]) for k, v in out.items()}


@pytest.mark.parametrize("shape", [(2, 3, 4), (5, 1, 3), (1, 1, 1)])
def test_transposes_and_flips(spark, shape):
    v = np.arange(np.prod(shape), dtype=float).reshape(shape)
    df = rows(spark, v)
    for axes, flip in (((2, 1, 0), None), ((0, 1, 2), (True, False, True)), ((1, 2, 0), (False, True, True))):
        want = v.transpose(axes)
        if flip:
            want = want[tuple(slice(None, None, -1) if f else slice(None) for f in flip)]
        by_column = [F.col("shape")[k] for k in range(3)]
        for sizes in (shape, by_column):
            assert df.select(arrays.transpose("data", sizes, axes, flip)).first()[0] == want.reshape(-1).tolist()


def test_orientation(spark):
    rng = np.random.default_rng(3)
    affines = [rng.normal(size=12).tolist() for _ in range(20)] + [[float(x) for x in (1, 0, 0, 0, 0, -2, 0, 0, 0, 0, 3, 0)], [float(x) for x in (0, 0, 5, 0, -1, 0, 0, 0, 0, 1, 0, 0)]]
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    df = spark.createDataFrame([(i, a, v.reshape(-1).tolist()) for i, a in enumerate(affines)], "i int, a array<double>, v array<float>")
    got = df.select("i", arrays.orientation("a").alias("o"), arrays.reorient("v", (2, 3, 4), "a").alias("r")).orderBy("i").collect()
    for r, a in zip(got, affines):
        want, _ = volume.reorient_ras(v, a)
        assert sorted(r.o["axes"]) == [0, 1, 2] and r.r == want.reshape(-1).tolist()


def test_plans_do_not_grow_with_the_shape(spark):
    df = rows(spark, np.zeros((1, 1, 1)))
    sizes = [len(df.select(f)._jdf.queryExecution().toString()) for s in (4, 200) for f in (arrays.pad_crop("data", (s, s, s), (s + 1, s - 1, s)),)]
    assert sizes[1] < 2 * sizes[0]  # 64 voxels and 8 million


@pytest.mark.parametrize("edge", [2, 3, 32])
def test_bricks_resample(spark, edge):
    rng = np.random.default_rng(edge)
    a, b = rng.normal(size=(7, 5, 4)), rng.normal(size=(2, 9, 1))
    whole = bricks.bricks_of_volumes(rows(spark, a, b), ["case_id"], edge=edge)
    same = back(whole, edge)
    assert np.array_equal(same[0], a) and np.array_equal(same[1], b)
    got = back(bricks.resample_grid(whole, ["case_id"], (5, 11, None), edge), edge)
    assert all(np.allclose(got[i], volume.resample_grid(v, (5, 11, v.shape[2])), atol=1e-5) for i, v in enumerate((a, b)))
    got = back(bricks.resample_spacing(whole, ["case_id"], (3.0, 1.0, 0.7), (1.25, 2.0, 0.7), fill=-9.0, edge=edge), edge)
    assert all(np.allclose(got[i], volume.resample_spacing(v, (3.0, 1.0, 0.7), (1.25, 2.0, 0.7), -9.0), atol=1e-5) for i, v in enumerate((a, b)))
    got = back(bricks.resample_truncated(whole, ["case_id"], (1.0, 1.0, 2.0), (1.9, 0.6, 1.0), edge), edge)
    assert all(np.allclose(got[i], volume.resample_truncated(v, (1.0, 1.0, 2.0), (1.9, 0.6, 1.0)), atol=1e-5) for i, v in enumerate((a, b)))


def test_images(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 255, (6, 9, 3)), rng.uniform(0, 255, (4, 2, 3))
    whole = bricks.bricks_of_volumes(rows(spark, a, b), ["case_id"], edge=4)
    for longest in (False, True):
        got = back(bricks.resize_images(whole, ["case_id"], 5, longest, edge=4), 4)
        assert all(np.allclose(got[i], volume.resize_bilinear(v.astype(np.float32), 5, longest), atol=1e-3) for i, v in enumerate((a, b)))
