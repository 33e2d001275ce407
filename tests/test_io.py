"""File round trips, streaming restarts, volumes and external calls."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.functions import arrays
from qaloom.operators import curate, external, metrics, volume
from qaloom.functions.porter import stem
from qaloom.sources import files, sinks, volumes
from qaloom.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_reports(spark, tmp_path):
    at = write(tmp_path / "r.csv", 'file_name,findings_en\na.nii.gz,"two\nlines"\n')
    assert [tuple(r) for r in files.read_reports_csv(spark, at).collect()] == [("a.nii.gz", "two\nlines", "")]
    at = write(tmp_path / "r.json", json.dumps({"a": {"Findings_EN": "f"}}))
    assert [tuple(r) for r in files.read_reports_json(spark, at).collect()] == [("a", "f", "")]


def test_qa_map_and_list(spark, tmp_path):
    at = write(tmp_path / "m.json", json.dumps({"c": {"qa_pairs": [{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]}}))
    assert [(r.case_id, r.idx, r.question) for r in files.read_qa(spark, at).collect()] == [("c", 0, "q"), ("c", 1, "r")]
    entries = [{"file_name": "x", "qa_pairs": [{"question": "old"}]}, {"qa_pairs": []}, {"case_id": "", "case": "x", "qa_pairs": [{"question": "new"}]}]
    at = write(tmp_path / "l.json", json.dumps(entries))
    assert [(r.case_id, r.question) for r in files.read_qa(spark, at).collect()] == [("x", "new")]


def test_jsonl(spark, tmp_path):
    at = write(tmp_path / "m_predictions.jsonl", '{"question":"a"}\n\n{"question":"b","answer":"x"}\n')
    got = files.read_jsonl(spark, at, schemas.PREDICTION).orderBy("pos").collect()
    assert [(r.model, r.pos, r.question) for r in got] == [("m", 0, "a"), ("m", 1, "b")]
    bad = write(tmp_path / "bad.jsonl", '{"question":"a"}\n{oops\n{"question":"c"}\n')
    assert [r.question for r in files.read_jsonl(spark, bad, schemas.PREDICTION, strict=False).orderBy("pos").collect()] == ["a", "c"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, schemas.PREDICTION).collect()
    assert files.read_json_or_lines(spark, bad, schemas.PREDICTION).count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in "ab":
        write(tmp_path / f"{name}.jsonl", "".join(f'{{"question":"{name}{i}"}}\n' + "\n \n" * (i % 3 == 0) for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert files.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = files.read_jsonl(spark, str(tmp_path), schemas.PREDICTION).select("model", "pos", "question").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.model, r.pos, r.question) for r in got) == sorted((n, i, f"{n}{i}") for n in "ab" for i in range(3000))


def test_items_stats_series_and_allow_list(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", "p", 0.5, "m"), ("r", None, "x", None, "n")], "question string, answer string, prediction string, bleu double, model string")
    sinks.write_items(rows, str(tmp_path / "items"), ["bleu"])
    lines = "".join(f.read_text() for f in sorted((tmp_path / "items").glob("part-*.json"))).splitlines()
    assert sorted((json.loads(x) for x in lines), key=lambda x: x["question"]) == [{"question": "q", "answer": "a", "prediction": "p", "bleu": 0.5}, {"question": "r", "prediction": "x"}]
    assert [json.loads(r.value) for r in sinks.stats_json(rows.groupBy("model").count().orderBy("model")).collect()] == [{"model": "m", "count": 1}, {"model": "n", "count": 1}]
    at = write(tmp_path / "series.json", json.dumps({"labels": ["m", "n"], "series": [[3, 1], []], "include_questions": True}))
    assert [tuple(r) for r in files.read_length_series(spark, at).orderBy("pos").collect()] == [("m", 0, 3, True), ("m", 1, 1, True)]
    assert curate.allowed_models(rows, ["n"]).count() == 1 and curate.allowed_models(rows, None).count() == 2


def test_many_files_of_bounded_size(spark, tmp_path):
    pairs = spark.createDataFrame([(c, i, f"q{c}{i}", 'a "quoted"\nline') for c in range(40) for i in (4, 2)], "case_id long, idx long, question string, answer string")
    for as_list in (False, True):
        at = tmp_path / f"qa-{as_list}"
        sinks.write_qa(pairs, str(at), as_list, cases_per_file=10)
        assert len(list(at.glob("part=*"))) > 1
        got = files.read_qa(spark, str(at)).select("case_id", "idx", "question", "answer").collect()
        assert sorted(map(tuple, got)) == sorted((str(c), k, f"q{c}{i}", 'a "quoted"\nline') for c in range(40) for k, i in ((0, 2), (1, 4)))


def test_judge_files(spark, tmp_path):
    rows = [{"question": "q", "is_correct": True, "jury_is_correct": False}, {"question": "r", "is_correct": None}]
    for name, body, want in (("a", rows, [True, None]), ("b", {"jury": rows}, [False, None]), ("c", {"items": rows}, [True, None]), ("d", {"else": 1}, [])):
        at = write(tmp_path / f"{name}_gpt_eval.json", json.dumps(body))
        got = files.read_judge(spark, at, "gpt").orderBy("pos").collect()
        assert [r.is_correct for r in got] == want and all(r.model == name for r in got)


def test_labels_keep_missing_and_null_apart(spark, tmp_path):
    at = write(tmp_path / "l.json", json.dumps({"c": [{}, {"is_spatial": None}, {"is_spatial": True, "is_relevant": False}]}))
    got = files.read_labels(spark, at).orderBy("pos").collect()
    assert [(r.has_spatial, r.is_spatial, r.has_relevant, r.is_relevant) for r in got] == [(False, None, False, None), (True, None, False, None), (True, True, True, False)]


def test_matrix_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("c::10", "m", 0.66), ("c::2", "m", None)], "question_id string, model string, score double")
    at = str(tmp_path / "matrix")
    sinks.write_csv(sinks.matrix_wide(s, ["m"]), at, ["question_id"])
    got = files.read_matrix(spark, at).orderBy("question_id").collect()
    assert [(r.question_id, r.model, r.score) for r in got] == [("c::10", "m", 0.66), ("c::2", "m", None)]
    with pytest.raises(ValueError):
        files.read_matrix(spark, write(tmp_path / "x.csv", "other,m\n1,2\n"))


def test_jsonl_sink_and_map(spark, tmp_path):
    p = spark.createDataFrame([("c", 1, "r", "b"), ("c", 0, "q", "a")], "case_id string, idx int, question string, answer string")
    assert json.loads(sinks.qa_map_json(p).first().value) == {"c": {"qa_pairs": [{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]}}
    sinks.write_jsonl(p, str(tmp_path / "o"), ["idx"], 1)
    lines = "".join(f.read_text() for f in sorted((tmp_path / "o").glob("part-*.json"))).splitlines()
    assert [json.loads(x)["idx"] for x in lines] == [0, 1]


def test_prediction_file_choice(spark):
    f = spark.createDataFrame([("ct_chat_predictions_full.jsonl",), ("ct-chat_predictions.jsonl",), ("ct-chat_full_predictions.jsonl",), ("x",)], "name string")
    assert files.pick_prediction_file(f, "ct-chat").first().name == "ct-chat_predictions.jsonl"
    assert files.pick_prediction_file(f, "ct_chat").first().name == "ct_chat_predictions_full.jsonl"
    assert files.pick_prediction_file(f, "none").count() == 0


def test_nifti_round_trip(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.nii.gz").write_bytes(volumes.encode_nifti(v, (1.5, 1.0, 3.0)))
    r = volumes.read_nifti(spark, str(tmp_path)).first()
    assert r.case_id == "a.nii.gz" and list(r.shape) == [2, 3, 4] and list(r.spacing) == [1.5, 1.0, 3.0]
    assert np.array_equal(np.array(r.data, np.float32).reshape(2, 3, 4), v)
    assert volumes.probe_depth(spark, str(tmp_path)).first().depth == 2
    assert files.list_volumes(spark, str(tmp_path)).first().name == "a.nii.gz"
    out = sinks.write_tensors(volumes.read_nifti(spark, str(tmp_path)), str(tmp_path)).first()
    content = spark.read.format("binaryFile").load(out.path).select(volumes.decode_tensor("content", rank=4, channels=3).alias("t")).first().t
    assert list(content.shape) == [3, 2, 3, 4]
    np.savez(tmp_path / "p.npz", slices=np.zeros((2, 4, 4, 3), np.uint8), slice_indices=np.array([3, 5], np.int32))
    pack = spark.read.format("binaryFile").load(str(tmp_path / "p.npz")).select(volumes.decode_slice_pack("content").alias("s")).first().s
    assert [(x.slice_idx, len(x.rgb)) for x in pack] == [(3, 48), (5, 48)]


def test_array_functions_match_numpy(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 700, (4, 4, 4)).astype(np.float32)
    df = spark.createDataFrame([(v.reshape(-1).tolist(),)], "a array<float>")
    get = lambda c: np.array(df.select(c.alias("v")).first().v)
    d = v.astype(float)
    assert np.allclose(get(arrays.clip("a", -1000, 1000)), d.clip(-1000, 1000).reshape(-1))
    assert np.allclose(get(arrays.minmax("a")), ((d - d.min()) / (d.max() - d.min())).reshape(-1))
    assert np.array_equal(get(arrays.transpose("a", (4, 4, 4), (2, 0, 1))), d.transpose(2, 0, 1).reshape(-1))
    assert np.array_equal(get(arrays.window_u8("a", -135, 215)), np.rint((d.clip(-135, 215) + 135) / 350 * 255).reshape(-1))
    assert get(arrays.pad_crop("a", (4, 4, 4), (7, 2, 4), -5.0)).reshape(7, 2, 4)[0].max() == -5
    line = spark.createDataFrame([([0.0, 1.0, 2.0],)], "a array<double>")
    assert line.select(arrays.pad_crop("a", (3,), (6,), -1.0)).first()[0] == [-1, 0, 1, 2, -1, -1] and line.select(arrays.crop_pad("a", (3,), (2,))).first()[0] == [0, 1]
    flat = spark.createDataFrame([([7.0] * 4,)], "a array<float>")
    assert flat.select(arrays.minmax("a").alias("v")).first().v == [0.0] * 4


def test_resampling():
    v = np.arange(8, dtype=np.float32).reshape(2, 2, 2)
    assert np.array_equal(volume.resample_grid(v, (2, 2, 2)), v)
    assert np.allclose(volume.interpolate(np.array([0.0, 4.0]), (4,)), [0, 1, 3, 4])
    assert volume.spacing_shape((3,), (1.0,), (2.0,)) == (2,) and volume.spacing_shape((3,), (1.0,), (2.0,), "truncate") == (1,)
    assert volume.resample_spacing(v, (1, 1, 1), (0.5, 1, 1)).shape == (4, 2, 2)
    assert volume.resample_spacing(v, (1, 1, 1), (0.5, 1, 1), fill=-1)[3].max() == -1
    out, b = volume.reorient_ras(v, np.array([[-1, 0, 0, 0], [0, 0, 2, 0], [0, 1, 0, 0]]))
    assert np.array_equal(out, np.flip(v, 0).transpose(0, 2, 1)) and (np.diag(b) > 0).all()
    img = np.full((2, 4, 3), 9, np.uint8)
    sq = volume.resize_bilinear(img, 8, longest=True, pad=True)
    assert sq.shape == (8, 8, 3) and sq[0].max() == 0 and sq[4].min() == 9
    box = volume.foreground_box(v, 5)
    assert [(s.start, s.stop) for s in box] == [(1, 2), (1, 2), (0, 2)]


def test_map_volumes(spark):
    df = spark.createDataFrame([("c", [2, 2, 2], [1.0, 1.0, 1.0], None, [float(i) for i in range(8)])], schemas.VOLUME)
    r = volume.map_volumes(df, lambda v, s, a: (volume.resample_grid(v, (1, 2, 2)), [2.0, 1.0, 1.0])).first()
    assert list(r.shape) == [1, 2, 2] and list(r.spacing) == [2.0, 1.0, 1.0] and list(r.data) == [2.0, 3.0, 4.0, 5.0]


def test_stemmer():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {k: stem(k) for k in known} == known


def test_metrics(spark):
    assert metrics.lcs_length(list("abcd"), list("axcd")) == 3 and metrics.lcs_length([], list("a")) == 0
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("", "x y"), ("running dogs", "run dog")], "prediction string, reference string")
    r = metrics.rouge(df).collect()
    assert (r[0].rouge1_f, r[0].rouge2_f, r[0].rougeL_f) == (1.0, 1.0, 1.0) and r[1].rouge1_f == 0.0 and r[2].rouge1_f > 0
    m = [x.m for x in df.select(metrics.meteor("prediction", "reference").alias("m")).collect()]
    assert round(m[0], 4) == round(1 - 0.5 * (1 / 6) ** 3, 4) and m[1] == 0.0 and m[2] > 0.5
    b = metrics.corpus_bleu(metrics.bleu_stats(df.limit(1), []), []).first()
    assert round(b.bleu, 6) == 100.0
    assert df.select(metrics.tokens_13a(F.lit("a,b 1,000 x-y 3-4.")).alias("t")).first().t == ["a", ",", "b", "1,000", "x-y", "3", "-", "4", "."]


def test_retry():
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise external.RateLimited()
        return "ok"

    r = external.Retry(jitter=lambda b: b / 4, sleep=waits.append)
    assert r.call(flaky, "x") == "ok" and waits == [2.5, 5.0]
    with pytest.raises(ValueError):
        r.call(lambda p: (_ for _ in ()).throw(ValueError()), "x")


def test_external_calls(spark):
    reports = spark.createDataFrame([("a", "f", ""), ("b", "bad", "")], "file_name string, findings_en string, impressions_en string")
    got = external.generate_pairs(reports, external.TableBackend({"bad": "oops"}, '[{"question":"q","answer":"a"}]')).orderBy("case_id").collect()
    assert (got[0].question, got[1].error, got[1].raw_output) == ("q", "unreadable", "oops")
    items = spark.createDataFrame([(i, "c", "q", "a", "p") for i in range(7)], "pos long, case_id string, question string, answer string, prediction string")
    judged = external.judge_answers(items, external.TableBackend({"3. ": '[{"is_correct":true},{"is_correct":false}]'}, "broken"))
    assert [(r.pos, r.is_correct) for r in judged.orderBy("pos").collect()] == [(0, True), (1, False), (5, None), (6, None)]
    batch = spark.createDataFrame([("c", 0, "x", 2), ("c", 1, "good", 1)], "case_id string, batch long, prompt string, n long")
    lab = external.label_batches(batch, external.TableBackend({"good": '[{"is_spatial":true,"is_relevant":null}]'}, "no")).orderBy("batch").collect()
    assert len(lab[0].results) == 2 and lab[0].results[0].reasoning.startswith("PARSE_ERROR") and lab[1].results[0].is_spatial
    pairs = spark.createDataFrame([("q1", "a", None), ("q2", "a", [])], "question string, answer string, category array<string>")
    assert [(r.question, r.category, r.status) for r in external.classify(pairs, external.EchoBackend('["A"]')).collect()] == [("q1", ["A"], "done")]
    ask = spark.createDataFrame([("c", None, "q")], "case_id string, image_path string, question string")
    assert external.predict(ask, external.EchoBackend(" yes ")).first().prediction == "yes"
    known = spark.createDataFrame([("c", "seen")], "case_id string, text_output string")
    joined, table = external.expert_once(ask.union(spark.createDataFrame([("d", None, "q")], ask.schema)), external.EchoBackend("new"), known)
    assert {(r.case_id, r.text_output) for r in joined.collect()} == {("c", "seen"), ("d", "new")} and table.count() == 2
    assert external.stops_at("a STOP b", ["STOP"]) == "a STOP"


def test_stream_restarts_without_loss(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    write(src / "a.json", '{"question":"1","prediction":"x"}\n')
    run = lambda: incremental.process_available(incremental.stream_jsonl(spark, str(src), schemas.PREDICTION), lambda d: d.select("question"), out, ck)
    run()
    write(src / "b.json", '{"question":"2","prediction":"y"}\n')
    run()
    run()
    assert sorted(r.question for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_incremental(spark):
    todo = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, o int")
    assert {r.o for r in incremental.pending_occurrences(todo, todo.limit(1), ["k"], "o").collect()} == {2, 3}
    placed = incremental.place_rows(todo, "o").orderBy("place").collect()
    assert [(r.o, r.place) for r in placed] == [(1, 0), (2, 1), (3, 2)]
    assert incremental.append_results(todo.select(F.col("o").cast("long").alias("pos")), spark.range(2).withColumnRenamed("id", "pos")).agg(F.max("pos")).first()[0] == 5
