"""Large JSON documents cut across file splits, against the whole-file reader."""

import json
import random

import pytest

from qaloom.sources import files
from qaloom.sources.json_splits import elements

NASTY = ['plain', 'a } b', '{"x": [1, 2}', 'quote " and \\ back', 'end\\', '},{', 'né日\n', '"', '[', '\\"}', "", " , "]


def value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.4:
        return rng.choice(NASTY)
    if kind < 0.5:
        return rng.choice([None, True, 1.5, -3])
    if kind < 0.7:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(NASTY) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_elements_equal_the_whole_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    want = {}
    for i in range(6):
        items = [value(rng) for _ in range(rng.randint(0, 12))]
        doc = items if i % 2 else {f"k{j} }}}}": x for j, x in enumerate(items)}
        text = json.dumps(doc, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"f{i}.json").write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n", " }"[:1]]))
        want[f"f{i}.json"] = items if i % 2 else [{k: v} for k, v in doc.items()]
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"b": ')
    (tmp_path / "scalar.json").write_text('"just } text"')
    rows = elements(spark, str(tmp_path)).collect()
    got = {n: [] for n in want}
    for r in sorted(rows, key=lambda r: (r.path, r.pos)):
        name = r.path.rsplit("/", 1)[1]
        got[name].append(json.loads(r.text if int(name[1]) % 2 else "{" + r.text + "}"))
    assert got == want
    assert all([r.pos for r in sorted(rows, key=lambda r: r.pos) if r.path.endswith(n)] == list(range(len(v))) for n, v in want.items())


def test_boxes(spark, tmp_path, small_splits):
    items = [{"question": f"q}} {i}", "is_correct": i % 2 == 0, "jury_is_correct": i % 3 == 0} for i in range(40)]
    (tmp_path / "a_gpt_eval.json").write_text(json.dumps({"n": 3, "items": items, "meta": [1, [2], {"x": "}"}]}))
    (tmp_path / "b_gpt_eval.json").write_text(json.dumps({"items": items[:2], "jury": items}))
    (tmp_path / "c_gpt_eval.json").write_text(json.dumps(items))
    (tmp_path / "d_gpt_eval.json").write_text(json.dumps({"other": items}))
    got = files.read_judge(spark, str(tmp_path), "gpt").orderBy("model", "pos").collect()
    by = {m: [(r.pos, r.question, r.is_correct) for r in got if r.model == m] for m in "abcd"}
    plain = [(i, x["question"], x["is_correct"]) for i, x in enumerate(items)]
    assert by == {"a": plain, "b": [(i, x["question"], x["jury_is_correct"]) for i, x in enumerate(items)], "c": plain, "d": []}


def test_one_long_list_is_many_tasks(spark, tmp_path):
    """A 30 MB list in one line, with splits of 2 MB: more than eight tasks, and all items in their places."""
    n = 60_000
    with open(tmp_path / "big_gpt_eval.json", "w") as out:
        out.write("[" + ", ".join(json.dumps({"case_id": str(i), "question": "x" * 400 + "}" * (i % 7), "is_correct": i % 2 == 0}) for i in range(n)) + "]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        from qaloom.sources import json_splits

        assert json_splits._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = files.read_judge(spark, str(tmp_path), "gpt").selectExpr("count(*) n", "sum(if(pos = cast(case_id as long), 1, 0)) placed", "sum(length(question)) chars").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tuple(got) == (n, n, n * 400 + sum(i % 7 for i in range(n)))
