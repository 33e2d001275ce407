"""The NIfTI reader's partitions, push-down and counters; the tensor writer's commit and abort."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.sources import datasources
from qaloom.sources.volumes import decode_nifti


@pytest.fixture(scope="module")
def source(spark):
    return datasources.register(spark)


@pytest.fixture(scope="module")
def folder(source, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nifti"))
    rng = np.random.default_rng(0)
    volumes = {f"v{i}": rng.normal(size=(70, 40, 30)).astype(np.float32) for i in range(4)}
    df = source.createDataFrame([(k, list(v.shape), v.reshape(-1).tolist()) for k, v in volumes.items()], datasources.TensorSink({}).schema()).repartition(3)
    for kind in ("nii", "nii.gz"):
        df.write.format("tensors").mode("append").option("kind", kind).save(f"{at}/{kind}")
    return at, volumes


def test_slabs(source, folder):
    at, volumes = folder
    for kind in ("nii", "nii.gz"):
        rows = source.read.format("nifti").option("slab", 32).load(f"{at}/{kind}").collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.z0):
            got.setdefault(r.case_id.split(".")[0], []).append(np.array(r.data, np.float32).reshape(r.depth, *r.shape[1:]))
        assert {k: [len(x) for x in v] for k, v in got.items()} == {k: [32, 32, 6] for k in volumes}
        assert all(np.array_equal(np.concatenate(got[k]), v) for k, v in volumes.items())
    parts = source.read.format("nifti").load(f"{at}/nii").rdd.getNumPartitions()
    assert parts == 12  # slabs of an uncompressed file are tasks of their own


def test_depth_probe_reads_headers_alone(source, folder):
    at, volumes = folder
    for kind in ("nii", "nii.gz"):
        files = source.read.format("nifti").option("voxels", "false").load(f"{at}/{kind}")
        rows = files.select("case_id", F.col("shape")[0].alias("depth"), "bytes_read", "data").collect()
        assert len(rows) == 4 and all(r.depth == 70 and r.data is None and r.bytes_read <= 4096 for r in rows)
        sizes = sum(os.path.getsize(f"{at}/{kind}/{r.case_id}") for r in rows)
        assert sum(r.bytes_read for r in rows) < sizes / 50


def test_filters_reach_the_reader(source, folder):
    at, volumes = folder
    files = source.read.format("nifti").load(f"{at}/nii")
    one = files.where("case_id = 'v1.nii' and z0 >= 32 and z0 <= 40")
    r = one.collect()
    assert len(r) == 1 and r[0].z0 == 32 and one.rdd.getNumPartitions() == 1
    assert files.where("case_id in ('v0.nii', 'v3.nii') and depth = 6").count() == 2
    assert files.where("case_id = 'nobody'").count() == 0


def test_a_failed_task_leaves_no_file(source, tmp_path):
    at = str(tmp_path / "out")
    rows = [(f"c{i}", [2, 2], [1.0, 2.0, 3.0, 4.0] if i != 5 else [1.0]) for i in range(8)]
    df = source.createDataFrame(rows, datasources.TensorSink({}).schema()).repartition(4)
    with pytest.raises(Exception, match="reshape"):
        df.write.format("tensors").mode("append").save(at)
    assert [f for _, _, names in os.walk(at) for f in names] == [] and not any("_job" in d for d in os.listdir(at))
    df.where("case_id <> 'c5'").write.format("tensors").mode("append").option("kind", "npz").save(at)
    assert sorted(os.listdir(at)) == [f"c{i}.npz" for i in range(8) if i != 5]
    assert np.load(f"{at}/c0.npz")["arr"].tolist() == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="appended"):
        df.write.format("tensors").mode("overwrite").save(at)


def test_reads_what_other_writers_write(source, folder):
    at, volumes = folder
    for k, v in volumes.items():
        with open(f"{at}/nii.gz/{k}.nii.gz", "rb") as f:
            assert np.array_equal(decode_nifti(f.read())["data"], v)
