"""Column functions on hand-written edge rows."""

import base64

from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions import paths, sampling, text

FENCE = "`" * 3


def one(spark, column, **values):
    """The value of a column expression over one row of string values."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'bigint'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_word_count(spark):
    for given, want in (("", 0), (None, 0), ("33 mm", 2), ("Ècole d'été", 3), ("a_b-c", 2)):
        assert one(spark, text.word_count("t"), t=given) == want


def test_normalize_strips_all_white_space(spark):
    assert one(spark, text.normalize("t"), t="\n a \t") == "a"
    assert one(spark, text.normalize("t", lower=True), t=" Ab ") == "ab"
    assert one(spark, text.normalize("t"), t=None) == ""


def test_code_fence(spark):
    assert one(spark, text.strip_code_fence("t"), t=f' {FENCE}json\n[{{"index":1}}]\n{FENCE} ') == '[{"index":1}]'
    assert one(spark, text.strip_code_fence("t"), t=" plain\n") == "plain"


def test_sanitize_and_repair(spark):
    assert one(spark, text.sanitize_json("t"), t='[{"i":1},\n]') == '[{"i":1}\n]'
    assert one(spark, text.sanitize_json("t"), t='[{"i":"1"}  {"i":2}\n  {"i":3}, ]') == '[{"i":"1"}, {"i":2},\n  {"i":3}]'
    assert one(spark, text.sanitize_json("t"), t='[{"i":1}{"i":2},]') == '[{"i":1}{"i":2}]'
    assert one(spark, text.repair_list("t"), t='[{"i":1},{"i"') == '[{"i":1}]'
    assert one(spark, text.repair_list("t"), t="nothing") is None
    assert one(spark, text.extract_list("t"), t="x [1] y") == "[1]"
    assert one(spark, text.extract_list("t"), t="] [") is None


def test_parse_cascade(spark):
    kind = T.StructType([T.StructField("i", T.IntegerType())])
    for given, want in (('[{"i":1}]', [1]), ('so: [{"i":1}] ok', [1]), ('[{"i":1},\n]', [1]), ('[{"i":1},{"i"', [1]), ("none", None), ("", None)):
        got = one(spark, text.parse_list("t", kind), t=given)
        assert (got if got is None else [r["i"] for r in got]) == want, given


def test_categories_as_python_reads_them(spark):
    cases = {
        '["a", 0, null, false]': ["a"], "['a'] tail": [], '["a"] tail': [], '[true, "x"]': ["True", "x"], "[True, 'x', False]": ["True", "x"],
        '["true", "0", "None"]': ["true", "0", "None"], '{"a": 1}': [], '"a"': [], "": [], "[]": [], '["a"], "b"': [], "['a' 'b']": ["a", "b"], '[1.5, 12]': ["1.5", "12"],
        '```json\n["a", "b"]\n```': ["a", "b"], '["a", [], {}, ""]': ["a"], "[' ', 'a']": ["", "a"], "[x, ' ', 'a']": ["a"], '["a",]': ["a"], "['it''s']": ["it", "s"],
    }
    for given, want in cases.items():
        assert one(spark, text.parse_categories("t"), t=given) == want, given


def test_categories(spark):
    assert one(spark, text.parse_categories("t"), t="['A','B']") == ["A", "B"]
    assert one(spark, text.parse_categories("t"), t='["A", " B "]') == ["A", "B"]
    assert one(spark, text.parse_categories("t"), t="none") == []
    assert one(spark, text.parse_categories("t"), t=r"""['it\'s', None, "b\\c", 0, 7, '',]""") == ["it's", r"b\c", "7"]
    assert one(spark, text.parse_categories("t"), t="""["A", broken, 'B']""") == ["A"]
    name = "Medial-Lateral Orientation"
    assert one(spark, text.canonical_categories("t"), t=[name, f"{name} (Centricity)", " "]) == [f"{name} (Centricity)"] * 2


def test_recover_verdict(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, text.recover_verdict(null, "t"), t='x "is_correct": false,') is False
    assert one(spark, text.recover_verdict(null, "t"), t="x") is None
    assert one(spark, text.recover_verdict(F.lit(True), "t"), t='"is_correct": false') is True


def test_small_helpers(spark):
    assert one(spark, text.first_truthy("a", "b"), a="", b="x") == "x"
    assert one(spark, text.default_text("a", "d"), a="") == "d"
    assert one(spark, text.strip_control_tokens("a"), a="<|begin_of_text|><|start_header_id|> hi <|end_header_id|><|eot_id|><|end_of_text|>") == "hi"
    assert one(spark, text.drop_prompt_echo("a", "p"), a=" Q? yes", p="Q?") == "yes"
    assert one(spark, text.drop_prompt_echo("a", "p"), a="well, Q? yes", p="Q?") == "well, Q? yes"
    assert one(spark, text.response_text("a", "p"), a="", p=["x", "y"]) == "x\ny"
    assert one(spark, text.model_of_file("a"), a="d/m3d_gpt_eval.json") == "m3d"
    for tail in ("_gemini2.5_eval_full.json", "_gemini2.5_eval_fixed.json", "_gemini2.5_eval.json", "_gemini_eval.json", "_qwen_eval.json", "_predictions_full.jsonl", "_predictions.jsonl"):
        assert one(spark, text.model_of_file("a"), a="x/ct_chat" + tail) == "ct_chat", tail
    assert one(spark, text.display_label("a", {"m": "M"}), a="m") == "M"
    assert one(spark, text.display_label("a", {"m": "M"}), a="z") == "z"
    assert one(spark, text.floor2(F.lit(2.0) / 3)) == 0.66
    assert one(spark, text.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, text.ratio(F.lit(1), F.lit(0), None)) is None
    assert one(spark, text.numbered_prompt("p"), p=["x", "y"]) == "1. x\n2. y"
    assert one(spark, text.data_uri(F.lit(b"ab"))) == "data:image/jpeg;base64,YWI="
    assert one(spark, text.data_uri(F.lit(b"ab" * 90))) == "data:image/jpeg;base64," + base64.b64encode(b"ab" * 90).decode()
    got = one(spark, text.chat_messages("q", "u", "s"), q="why", u=["d1", "d2"])
    assert [(r["type"], r["value"]) for r in got] == [("system", "s"), ("image", "d1"), ("text", "SLICE 1"), ("image", "d2"), ("text", "SLICE 2"), ("text", "why")]


def test_paths(spark):
    assert one(spark, paths.base_volume("t"), t="valid_1_a_1.nii.gz") == "valid_1_a"
    assert one(spark, paths.base_volume("t"), t="plain") == ""
    assert one(spark, paths.variant("t"), t="valid_1_a_1.nii.gz") == "1"
    for given, want in (("x/valid_1_a_1.npy", "valid_1_a_1.nii.gz"), ("valid_1_a_1", "valid_1_a_1.nii.gz"), ("foo.npz", "foo.nii.gz")):
        assert one(spark, paths.normalize_image_id("t"), t=given) == want
    assert one(spark, paths.resolve_path("t", "r"), t='"valid_1_a_2"') == "r/valid_1/valid_1_a/valid_1_a_2.nii.gz"
    assert one(spark, paths.resolve_path("t", "r"), t="Valid_1_a_2") == "r/Valid_1_a_2.nii.gz"
    assert one(spark, paths.resolve_path("t", "r", any_case=True), t="Valid_1_a_2") == "r/Valid_1/Valid_1_a/Valid_1_a_2.nii.gz"
    assert one(spark, paths.resolve_by_stem("t", "r"), t="scan_1_a_2.npy") == "r/scan_1/scan_1_a/scan_1_a_2.nii.gz"
    assert one(spark, paths.output_path("t", "o", ".npy"), t="a/b.nii.gz") == "o/b.npy"


def test_slice_sampling(spark):
    for n, k, want in ((3, 5, [0, 1, 2]), (10, 4, [0, 3, 6, 9]), (10, 0, []), (10, 1, [0]), (0, 3, []), (6, 3, [0, 2, 5])):
        assert one(spark, sampling.uniform_indices(n, k)) == want, (n, k)
    items = F.sequence(F.lit(0), F.lit(9))
    assert one(spark, sampling.downsample(items, 1)) == [5]
    assert one(spark, sampling.downsample(items, 0)) == [5]
    assert one(spark, sampling.downsample(items, 0, "all")) == list(range(10))
    assert one(spark, sampling.downsample(items, 4)) == [0, 3, 6, 9]
    assert one(spark, sampling.fit_slices(F.lit(10), 100, 50, 500)) == 4
    assert one(spark, sampling.fit_slices(F.lit(3), 100, 5000, 500)) == 1
