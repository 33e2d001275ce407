"""Labels, defaults, generated answers and prompts; pairs to be categorised; catalogue batches and sink rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import curate
from ..session import table
from ..sources import files, sinks
from . import _data as D
from .registry import query

LABELS = {"en": "English", "de": "German"}
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


@query("display_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label FROM documents")
def display_labels(spark, sf):
    return D.documents(spark, sf).select("doc_id", text.display_label("lang", LABELS).alias("label"))


@query("first_truthy_field", """SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 3 = 0 THEN '' ELSE text END, ''), nullif(role, '')) AS picked,
 coalesce(nullif(CASE WHEN turn % 2 = 1 THEN text END, ''), 'Describe the scan.') AS question FROM conversations""")
def first_truthy_field(spark, sf):
    said = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    asked = F.when(F.col("turn") % 2 == 1, F.col("text"))
    return _turns(spark, sf).select("conv_id", "turn", text.first_truthy(said, "role").alias("picked"), text.default_text(asked, "Describe the scan.").alias("question"))


@query("generated_answer", f"""SELECT conv_id, turn, {_STRIP.format('text')} AS answer,
 CASE WHEN conv_id % 2 = 0 THEN {_STRIP.format('text')} ELSE 'well, Q' || turn || '? ' || text END AS without_echo FROM conversations""")
def generated_answer(spark, sf):
    raw = F.concat(F.lit("<|begin_of_text|><|start_header_id|>\n"), "text", F.lit(" <|end_header_id|><|eot_id|>\n<|end_of_text|>"))
    prompt = F.concat(F.lit("Q"), F.col("turn").cast("string"), F.lit("?"))
    echoed = F.concat(F.when(F.col("conv_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("well, ")), prompt, F.lit(" "), "text")
    return _turns(spark, sf).select("conv_id", "turn", text.strip_control_tokens(raw).alias("answer"), text.drop_prompt_echo(echoed, prompt).alias("without_echo"))


@query("response_parts", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 OR coalesce(text, '') = '' THEN concat_ws(chr(10), text, role) ELSE text END AS answer FROM conversations")
def response_parts(spark, sf):
    own = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("text"))
    parts = F.array("text", F.lit(None).cast("string"), "role")
    return _turns(spark, sf).select("conv_id", "turn", text.response_text(own, parts).alias("answer"))


@query("numbered_prompts", "SELECT conv_id, turn, '1. ' || coalesce(role, '') || chr(10) || '2. ' || coalesce(text, '') AS prompt FROM conversations")
def numbered_prompts(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", text.numbered_prompt(F.array("role", "text")).alias("prompt"))


@query("chat_prompt", """SELECT conv_id, turn, 'system=Answer briefly.' || chr(10) || 'image=data:image/jpeg;base64,' || base64(encode(text)) || chr(10) || 'text=SLICE 1' || chr(10) ||
 'image=data:image/jpeg;base64,' || base64(encode(role)) || chr(10) || 'text=SLICE 2' || chr(10) || 'text=' || role AS prompt FROM conversations""")
def chat_prompt(spark, sf):
    uris = F.array(text.data_uri(F.col("text").cast("binary")), text.data_uri(F.col("role").cast("binary")))
    said = F.transform(text.chat_messages("role", uris, "Answer briefly."), lambda m: F.concat(m["type"], F.lit("="), m["value"]))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(said, "\n").alias("prompt"))


@query("pairs_to_categorize", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR text IS NULL OR source IS NULL THEN 'invalid' WHEN doc_id % 3 = 2 THEN 'todo' ELSE 'done' END AS status FROM documents""")
def pairs_to_categorize(spark, sf):
    known = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array("lang"))
    pairs = D.documents(spark, sf).select("doc_id", F.col("source").alias("question"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("answer"), known.alias("category"))
    valid, invalid = curate.valid_pairs(pairs)
    parts = ((curate.uncategorized(valid), "todo"), (valid.where("category is not null"), "done"), (invalid, "invalid"))
    todo, done, bad = (p.select("doc_id", F.lit(s).alias("status")) for p, s in parts)
    return todo.unionByName(done).unionByName(bad)


@query("model_allow_list", "SELECT source AS model, count(*) AS n FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents) GROUP BY 1")
def model_allow_list(spark, sf):
    rows = D.documents(spark, sf).select(F.col("source").alias("model"))
    allowed = rows.agg(F.min("model"), F.max("model")).first()
    return curate.allowed_models(rows, list(allowed)).groupBy("model").agg(F.count("*").alias("n"))


@query("stats_json_rows", """SELECT '{"lang":"' || lang || '","n":' || count(*) || ',"longest":' || max(n_chars) || '}' AS value FROM documents GROUP BY lang""")
def stats_json_rows(spark, sf):
    return sinks.stats_json(D.documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")))


@query("scored_items", "SELECT source AS question, lang AS answer, text AS prediction, n_chars FROM documents")
def scored_items(spark, sf):
    d = D.documents(spark, sf).select("doc_id", F.col("source").alias("question"), F.col("lang").alias("answer"), F.col("text").alias("prediction"), "n_chars")
    return sinks.item_rows(d, ["n_chars"])


@query("catalog_batches", "SELECT page_id, url AS name, page_id // 100 AS batch FROM pages")
def catalog_batches(spark, sf):
    return files.catalog_batches(table(spark, sf, "pages").select("page_id", F.col("url").alias("name")), "page_id")
