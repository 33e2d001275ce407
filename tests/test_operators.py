"""Relational operators on tiny inputs, one trap after another."""

from collections import defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.operators import align, curate, judge, stats
from qaloom.sources.sinks import matrix_wide, ragged_union


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_missing_and_null_labels(spark):
    pairs = spark.createDataFrame([("c", i) for i in range(5)] + [("d", 0)], "case_id string, idx int")
    labels = spark.createDataFrame(
        [("c", 0, False, None, False, None), ("c", 1, True, None, False, None), ("c", 2, True, False, False, None), ("c", 3, True, True, True, False), ("d", 0, True, False, True, False)],
        "case_id string, pos int, has_spatial boolean, is_spatial boolean, has_relevant boolean, is_relevant boolean",
    )
    joined = curate.label_pairs(pairs, labels)
    assert rows(curate.filter_pairs(joined), "case_id", "idx") == [("c", 0), ("c", 4)]
    assert rows(curate.removal_counts(joined), "reason", "n") == [("kept", 2), ("non_relevant", 1), ("non_spatial", 3)]
    assert rows(curate.filter_pairs(joined, keep_nonspatial=True), "case_id", "idx") == [("c", 0), ("c", 1), ("c", 2), ("c", 4)]


def test_images(spark):
    pairs = spark.createDataFrame([("a", "q", "x"), ("b", "q", "x"), ("z", "q", "x")], "case_id string, question string, answer string")
    first = spark.createDataFrame([("a", "1")], "case_id string, image_path string")
    second = spark.createDataFrame([("a", "9"), ("b", "2")], "case_id string, image_path string")
    assert rows(curate.with_images(pairs, first, second, skip_missing=True), "case_id", "image_path") == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="no image"):
        curate.with_images(pairs, first, second).collect()
    many = spark.createDataFrame([("k", "p1", 1), ("k", "p2", 2)], "k string, p string, o int")
    assert rows(curate.image_map(many, "k", "p", "o"), "p") == [("p1",)]
    assert rows(curate.image_map(many, "k", "p", "o", "last"), "p") == [("p2",)]


def test_votes(spark):
    v = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, None), ("b", 1, True), ("b", 2, False), ("c", 1, None), ("c", 2, None)], "q string, j int, is_correct boolean")
    assert rows(judge.mean_vote_long(v, ["q"]), "q", "score") == [("a", 0.66), ("b", 0.5), ("c", 0.0)]
    m = {r["q"]: r["jury_is_correct"] for r in judge.majority(v, ["q"]).collect()}
    assert m == {"a": True, "b": True, "c": None}
    s = {r["q"]: (r["accuracy"], r["judged"]) for r in judge.single_judge_accuracy(v, ["q"]).collect()}
    assert s == {"a": (1.0, 2), "b": (0.5, 2), "c": (0.0, 0)}


def test_accuracy_policies(spark):
    s = spark.createDataFrame([("m", 0.66), ("m", None), ("m", 0.5)], "model string, score double")
    assert rows(judge.jury_accuracy(s), "accuracy", "n") == [(0.5, 2)]
    assert rows(judge.jury_accuracy(s, missing="zero"), "n") == [(3,)]
    with pytest.raises(ValueError):
        judge.jury_accuracy(s, missing="other")


def test_category_counts_twice(spark):
    s = spark.createDataFrame([("q1", "m", 1.0), ("q2", "m", None), ("q3", "m", 1.0)], "question_id string, model string, score double")
    c = spark.createDataFrame([("q1", ["A", "A"]), ("q2", ["A"]), ("q3", [])], "question_id string, category array<string>")
    r = judge.category_performance(s, c).first()
    assert (r["category"], round(r["pct"], 4), r["n"]) == ("A", 66.6667, 3)
    assert judge.category_performance(s, c, missing="skip").first()["pct"] == 100.0


def test_occurrences(spark):
    q = spark.createDataFrame([("i.nii.gz", "q", None, "i.nii.gz::0"), ("i.nii.gz", " q", "", "i.nii.gz::1")], "image_id string, question string, answer string, qid string")
    p = spark.createDataFrame([("d/i.npy", "q ", "", 5), ("i", "q", None, 7), ("i.nii.gz", "\nq", " ", 9), (None, "q", "", 10)], "image_id string, question string, answer string, pos long")
    assert rows(align.assign_question_ids(p, q), "pos", "qid") == [(5, "i.nii.gz::0"), (7, "i.nii.gz::1"), (9, "i.nii.gz::9"), (10, "unknown::10")]


def test_occurrences_in_blocks(spark):
    """Blocks of two places against one count a key, with null keys, null and negative places, and a place column that is no integer."""
    data = [(k, p) for k, ps in (("a", [*range(-3, 14)]), (None, [1, 2, 9, 30]), ("b", [7]), ("c", [None, 5])) for p in ps]
    d = spark.createDataFrame(data, "k string, pos int").withColumn("name", F.format_string("%05d", F.col("pos") + 100))
    want = sorted((str(k), str(p), sum(1 for x, q in data if x == k and (q is None, q or 0) != (p is None, p or 0) and (q is None or (p is not None and q < p)))) for k, p in data)
    for order in (["pos"], ["name"]):
        got = align.with_occurrence(d, ["k"], order, "n", bits=1).collect()
        assert [f.name for f in align.with_occurrence(d, ["k"], order, "n").schema] == ["k", "pos", "name", "n"]
        assert sorted((str(r.k), str(r.pos), r.n) for r in got) == want
    assert align.with_occurrence(d.limit(0), ["k"], ["pos"]).count() == 0


def test_judges_of_unequal_length(spark):
    v = spark.createDataFrame([("m", j, i) for j, n in (("x", 5), ("y", 5), ("z", 4)) for i in range(n)], "model string, judge string, pos int")
    assert align.zip_judges(v).count() == 12


def test_batches_and_zip(spark):
    items = align.batches(spark.range(7).withColumnRenamed("id", "pos"), 5)
    assert rows(items, "pos", "batch", "index")[4:6] == [(4, 0, 5), (5, 1, 1)]
    got = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["d", "e", "f"])], "batch long, results array<string>")
    assert rows(align.batch_zip(items, got), "pos", "result") == [(0, "a"), (1, "b"), (2, "c"), (5, "d"), (6, "e")]
    assert rows(align.lost_rows(items, got), "batch", "lost") == [(0, 2), (1, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_fifo_equals_queues(spark, judged, predicted):
    queues = defaultdict(deque)
    for i, q in enumerate(predicted):
        queues[q].append(f"id{i}")
    want = [(i, queues[q].popleft() if queues[q] else f"unknown::m::{i}") for i, q in enumerate(judged)]
    schema = "model string, question string, answer string, pos long, qid string"
    j = spark.createDataFrame([("m", q, "", i, None) for i, q in enumerate(judged)], schema).drop("qid")
    p = spark.createDataFrame([("m", q, "", i, f"id{i}") for i, q in enumerate(predicted)], schema)
    assert rows(align.fifo_question_ids(j, p), "pos", "qid") == want


def test_matrix(spark):
    s = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "a", 1.0, 2), ("q", "b", None, 1)], "question_id string, model string, score double, pos int")
    r = matrix_wide(judge.correctness(s), ["a", "b", "c"]).first()
    assert (r["a"], r["b"], r["c"]) == ("1.00", "", "")
    assert ragged_union(s.select("pos", "model"), s.select("score")).columns == ["model", "pos", "score"]


def test_summary_and_histogram(spark):
    d = spark.createDataFrame([(v,) for v in (0, 1, 5, 6, 100, 101)], "v int")
    assert rows(stats.histogram(spark, d, "v"), "bin", "n") == sorted([("0", 1), ("1-5", 2), ("6-10", 1), ("11-20", 0), ("21-30", 0), ("31-40", 0), ("41-50", 0), ("51-100", 1), (">100", 1)])
    none = d.where("v > 1000")
    assert stats.histogram(spark, none, "v").count() == 0
    r = stats.summary(none, "v").first()
    assert r["count"] == 0 and r["mean"] is None
    r = stats.summary(d, "v").first()
    assert (r["count"], r["median"], r["min"], r["max"]) == (6, 5.5, 0, 101)


def test_kde_integrates_to_one(spark):
    d = spark.createDataFrame([("a", float(v % 17)) for v in range(200)], "l string, v double")
    k = stats.kde(d, "l", "v").toPandas().sort_values("x")
    step = k.x.iloc[1] - k.x.iloc[0]
    assert 0.85 < k.density.sum() * step <= 1.01
    v = stats.violin(stats.kde(d, "l", "v"), stats.quartiles(d, "l", "v"), "l")
    assert v.agg(F.max("width"), F.count_if("at_median")).first()[:] == (1.0, 1)


def test_progress(spark):
    a = spark.createDataFrame([("u", "c", True), ("u", "c", False), ("u", "d", True), ("w", "e", False)], "user string, case string, answered boolean")
    assert rows(judge.progress(a), "case", "status") == [("c", "in_progress"), ("d", "complete"), ("e", "not_started")]
    assert rows(judge.user_progress(judge.progress(a)), "user", "status", "complete") == [("u", "in_progress", 1), ("w", "not_started", 0)]


def test_replica_and_errors(spark):
    a = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y")], "case_id string, idx int, v string")
    b = spark.createDataFrame([("c", 1, None), ("c", 2, "w")], "case_id string, idx int, v string")
    assert {(r["idx"], r["v"]) for r in curate.merge_replicas(a, b, ["v"]).collect()} == {(0, "x"), (1, None), (2, "w")}
    p = spark.createDataFrame([("q", "a"), (None, None)], "question string, answer string")
    good, bad = curate.valid_pairs(p)
    assert (good.count(), bad.count()) == (1, 1)
