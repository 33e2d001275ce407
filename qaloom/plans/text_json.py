"""Paths, text normalisation and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text
from ..session import table
from . import _data as D
from .registry import query

_CASE = "CASE WHEN conv_id % 4 = 0 THEN 'scan_' ELSE 'valid_' END || CAST(conv_id AS VARCHAR) || '_a_' || CAST(turn AS VARCHAR) || CASE turn % 3 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.npy' ELSE '' END"
_NAMES = f"(SELECT conv_id, turn, {_CASE} AS name FROM conversations)"


def _names(spark, sf):
    c = table(spark, sf, "conversations")
    head = F.when(F.col("conv_id") % 4 == 0, "scan_").otherwise("valid_")
    tail = F.when(F.col("turn") % 3 == 0, ".nii.gz").when(F.col("turn") % 3 == 1, ".npy").otherwise("")
    return c.select("conv_id", "turn", F.concat(head, F.col("conv_id").cast("string"), F.lit("_a_"), F.col("turn").cast("string"), tail).alias("name"))


@query("path_resolve", f"""SELECT conv_id, turn, CASE WHEN split_part(n, '_', 1) = 'valid' THEN 'root/' || split_part(n, '_', 1) || '_' || split_part(n, '_', 2) || '/' || split_part(n, '_', 1) || '_' || split_part(n, '_', 2) || '_' || split_part(n, '_', 3) || '/' ELSE 'root/' END || n || '.nii.gz' AS path,
 'root/' || regexp_replace(regexp_replace(n, '_[^_]*$', ''), '_[^_]*$', '') || '/' || regexp_replace(n, '_[^_]*$', '') || '/' || n || '.nii.gz' AS by_stem
 FROM (SELECT conv_id, turn, regexp_replace(name, '\\.(nii\\.gz|npy)$', '') AS n FROM {_NAMES})""")
def path_resolve(spark, sf):
    return _names(spark, sf).select("conv_id", "turn", paths.resolve_path("name", "root", swap=(".npy",)).alias("path"), paths.resolve_by_stem("name", "root").alias("by_stem"))


@query("image_id_normalize", f"SELECT conv_id, turn, CASE WHEN name LIKE '%.nii.gz' THEN name ELSE regexp_replace(name, '\\.npy$', '') || '.nii.gz' END AS image_id FROM {_NAMES}")
def image_id_normalize(spark, sf):
    return _names(spark, sf).select("conv_id", "turn", paths.normalize_image_id(F.concat(F.lit("a/b/"), "name")).alias("image_id"))


@query("base_variant", f"SELECT conv_id, turn, regexp_replace(name, '_[^_]*$', '') AS base_volume, replace(split_part(name, '_', -1), '.nii.gz', '') AS variant FROM {_NAMES}")
def base_variant(spark, sf):
    return _names(spark, sf).select("conv_id", "turn", paths.base_volume("name").alias("base_volume"), paths.variant("name").alias("variant"))


@query("output_path", f"SELECT conv_id, turn, 'out/' || regexp_replace(name, '(\\.nii\\.gz|\\.npy)$', '') || '.npz' AS path FROM {_NAMES}")
def output_path(spark, sf):
    return _names(spark, sf).select("conv_id", "turn", paths.output_path("name", "out", ".npz").alias("path"))


_RAW = "chr(10) || ' ' || coalesce(text, '') || ' ' || chr(9)"


def _raw(spark, sf):
    return D.documents(spark, sf).select("doc_id", F.concat(F.lit("\n "), F.coalesce("text", F.lit("")), F.lit(" \t")).alias("t"))


@query("text_normalize", f"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, lower(regexp_replace({_RAW}, '^\\s+|\\s+$', '', 'g')) AS t FROM documents)")
def text_normalize(spark, sf):
    t = _raw(spark, sf).select("doc_id", text.normalize("t", lower=True).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query("code_fence_strip", "SELECT event_id, props AS body FROM events")
def code_fence_strip(spark, sf):
    e = table(spark, sf, "events")
    fenced = F.concat(F.lit(f" {text.FENCE}json\n"), "props", F.lit(f"\n{text.FENCE}\n"))
    return e.select("event_id", text.strip_code_fence(F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit(" "), "props", F.lit("\n")))).alias("body"))


_FIXED = """CASE event_id % 3 WHEN 0 THEN '[' || props || ',' || chr(10) || '  ' || props || chr(10) || ']'
 WHEN 1 THEN '[{"a": "' || event_type || '"}, {"a": 1}]' ELSE '[' || props || ']' END"""


@query("sanitize_json", f"SELECT event_id, {_FIXED} AS fixed FROM events")
def sanitize_json(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 3
    lines = F.concat(F.lit("["), "props", F.lit("\n  "), "props", F.lit(",\n]"))
    objects = F.concat(F.lit('[{"a": "'), "event_type", F.lit('"}  {"a": 1},]'))
    return e.select("event_id", text.sanitize_json(F.when(m == 0, lines).when(m == 1, objects).otherwise(F.concat(F.lit("["), "props", F.lit(", ]")))).alias("fixed"))


@query("regex_recover", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN doc_id % 2 = 0 END AS verdict FROM documents")
def regex_recover(spark, sf):
    d = D.documents(spark, sf)
    verdict = F.when(F.col("doc_id") % 3 == 0, True)
    said = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('bad {"is_correct" : '), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit(","))).otherwise("none")
    return d.select("doc_id", text.recover_verdict(verdict, said).alias("verdict"))


@query("json_props_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, sf):
    listed = text.parse_list(F.concat(F.lit("["), "props", F.lit("]")), T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, sf, "events").select("event_id", listed[0]["k"].alias("k"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("json_list_extract", f"SELECT event_id, {_K} AS first_k, 2::BIGINT AS n FROM events")
def json_list_extract(spark, sf):
    e = table(spark, sf, "events")
    noisy = F.concat(F.lit("Sure: ["), "props", F.lit(","), "props", F.lit("] done"))
    got = text.parse_list(noisy, T.StructType([T.StructField("k", T.LongType())]))
    return e.select("event_id", got[0]["k"].alias("first_k"), F.size(got).cast("long").alias("n"))


@query("json_truncated_repair", "SELECT event_id, '[' || props || ',' || props || ']' AS repaired FROM events")
def json_truncated_repair(spark, sf):
    e = table(spark, sf, "events")
    cut = F.concat(F.lit("x ["), "props", F.lit(","), "props", F.lit(', {"k'))
    return e.select("event_id", text.repair_list(cut).alias("repaired"))


@query("category_parse", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN lang || ';' || source WHEN 1 THEN lang || ';' || source WHEN 2 THEN 'Medial-Lateral Orientation (Centricity);Medial-Lateral Orientation (Centricity)' WHEN 3 THEN 'it''s;' || lang WHEN 4 THEN lang WHEN 5 THEN '' WHEN 6 THEN 'True;' || lang || ';7' ELSE '' END AS labels FROM documents")
def category_parse(spark, sf):
    d = D.documents(spark, sf)
    m = F.col("doc_id") % 8
    raw = (
        F.when(m == 0, F.concat(F.lit('["'), "lang", F.lit('", " '), "source", F.lit('"]')))
        .when(m == 1, F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit(" ']")))
        .when(m == 2, F.lit('["Medial-Lateral Orientation", "Medial-Lateral Orientation (Centricity)", " "]'))
        .when(m == 3, F.concat(F.lit("['it\\'s', None, \""), "lang", F.lit('",]')))
        .when(m == 4, F.concat(F.lit('["'), "lang", F.lit('", 0, null, false, "", 0.0]')))
        .when(m == 5, F.concat(F.lit("['"), "lang", F.lit("'] tail")))
        .when(m == 6, F.concat(F.lit('[true, "'), "lang", F.lit('", 7]')))
        .otherwise(F.concat(F.lit('["'), "lang", F.lit('"] ["more"')))
    )
    return d.select("doc_id", F.array_join(text.canonical_categories(text.parse_categories(raw)), ";").alias("labels"))


@query("model_names_from_files", "SELECT doc_id, source AS model FROM documents")
def model_names_from_files(spark, sf):
    d = D.documents(spark, sf)
    tails = ["_gemini2.5_eval_full.json", "_gemini2.5_eval_fixed.json", "_gemini2.5_eval.json", "_gemini_eval.json", "_gpt_eval.json", "_qwen_eval.json", "_predictions_full.jsonl", "_predictions.jsonl"]
    tail = F.element_at(F.array(*(F.lit(s) for s in tails)), (F.col("doc_id") % len(tails)).cast("int") + 1)
    return d.select("doc_id", text.model_of_file(F.concat(F.lit("dir/"), "source", tail)).alias("model"))
