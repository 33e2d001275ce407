"""Occurrence and FIFO joins on streams, in batches and with a restart, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import align
from qaloom.streaming import incremental

SCHEMA = "model string, question string, answer string, pos long, qid string"


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(4)
    some = lambda n, name: [(rng.choice(["m1", "m2"]), rng.choice(["q", " r ", None]), rng.choice(["yes", "no\n"]), i, f"{name}{i}") for i in range(n)]
    return some(90, "j"), some(70, "p")


def run(spark, tmp_path, limit_ms=None):
    read = lambda name: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    incremental.process_available(incremental.stream_question_ids(read("left"), read("right"), limit_ms), lambda df: df, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def test_stream_equals_the_batch_join(spark, sides, tmp_path):
    """Five batches a side, with a restart between them: the pairs of the batch operator, each once."""
    incremental.stateful(spark)
    left, right = sides
    put = lambda name, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / name))
    for k in range(5):
        put("left", left[k * 18 : (k + 1) * 18])
        put("right", right[k * 14 : (k + 1) * 14])
        if k in (1, 4):
            run(spark, tmp_path)  # the second call goes on where the first one has ended
    got = spark.read.parquet(str(tmp_path / "out")).select("pos", "qid").collect()
    want = align.fifo_question_ids(spark.createDataFrame(left, SCHEMA).drop("qid"), spark.createDataFrame(right, SCHEMA))
    matched = {(r.pos, r.qid) for r in want.where(~F.col("qid").startswith("unknown::")).collect()}
    assert len(got) == len(matched) and {tuple(r) for r in got} == matched and len(matched) > 50


def test_a_time_limit_lets_go(spark, tmp_path):
    """A judgment that has waited longer than the limit goes out unmatched; one that is matched in time does so once."""
    import time

    incremental.stateful(spark)
    put = lambda name, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / name))
    put("left", [("m", "q", "a", 0, None), ("m", "other", "a", 1, None)])
    put("right", [("m", "other", "a", 0, "p0")])
    read = lambda name: spark.readStream.schema(SCHEMA).json(str(tmp_path / name))
    out = incremental.stream_question_ids(read("left"), read("right"), limit_ms=500)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    got, began = set(), time.time()
    while len(got) < 2 and time.time() < began + 90:
        time.sleep(2)
        got = {tuple(r) for r in spark.read.schema("pos long, qid string").parquet(str(tmp_path / "out")).collect()} if q.recentProgress else set()
    q.stop()
    assert got == {(0, "unknown::m::0"), (1, "p0")}
