"""File queries: two calls live side by side, and nothing stays in the shared folder."""

import gc
import os
import time

import pytest

from qaloom.plans import files, load

NAMES = ["reports_csv_files", "qa_map_files", "qa_list_files", "jsonl_strict_files", "jsonl_lenient_files", "json_or_lines_files", "judge_list_files", "judge_jury_files", "judge_item_files", "matrix_files"]


def left(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


def test_two_calls_each_and_an_empty_folder(spark, sf):
    queries = load()[0]
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    gc.collect()
    spark._jvm.System.gc()
    for name in NAMES:
        first, second = queries[name](spark, sf), queries[name](spark, sf)
        # rows derived from a result outlive the result itself
        counts = [first.where("true").select(*first.columns), second]
        del first, second
        gc.collect()
        a, b = (sorted(map(tuple, x.collect()), key=str) for x in counts)
        assert a == b and a, name
        del counts
    assert not [x for x in os.listdir(folder) if "files" in x]
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        if not left(folder):
            break
        time.sleep(0.5)
    assert left(folder) == []


def test_too_many_models_for_a_matrix(spark, sf, monkeypatch):
    monkeypatch.setattr(files, "MOST_MODELS", 2)
    with pytest.raises(ValueError, match="more than 2 models"):
        load()[0]["matrix_files"](spark, sf)
