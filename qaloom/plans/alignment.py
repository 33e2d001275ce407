"""Alignment by occurrence, position and batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, judge
from ..session import table
from . import _data as D
from .registry import query

_KEY = "md5(text)"
#: Questions of two in three documents belong to another image, so their predictions find none.
_IMAGE = "(lang || CASE WHEN doc_id % 3 = 0 THEN '.nii.gz' ELSE '.other.nii.gz' END)"
#: Judgments of even documents have a question that nobody was asked.
_ASKED = "(md5(text) || CASE WHEN doc_id % 2 = 0 THEN '?' ELSE '' END)"


def _docs(spark, sf):
    return D.documents(spark, sf).select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("question"))


@query("occurrence_join", f"""WITH p AS (SELECT doc_id AS pos, lang || '.nii.gz' AS image_id, {_KEY} AS question, row_number() OVER (PARTITION BY lang, {_KEY} ORDER BY doc_id) AS k FROM documents),
 q AS (SELECT 'id' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS qid, {_IMAGE} AS image_id, {_KEY} AS question, row_number() OVER (PARTITION BY {_IMAGE}, {_KEY} ORDER BY doc_id) AS k FROM documents)
 SELECT pos, coalesce(qid, image_id || '::' || CAST(pos AS VARCHAR)) AS qid FROM p LEFT JOIN q USING (image_id, question, k)""")
def occurrence_join(spark, sf):
    d = _docs(spark, sf).withColumnRenamed("lang", "image_id")
    p = d.withColumnRenamed("doc_id", "pos").withColumn("question", F.concat(F.lit(" "), "question", F.lit("\n"))).withColumn("answer", F.lit(None).cast("string"))
    image = F.concat("image_id", F.when(F.col("doc_id") % 3 == 0, ".nii.gz").otherwise(".other.nii.gz"))
    q = d.withColumn("image_id", image).withColumn("answer", F.lit("")).withColumn("qid", F.concat(F.lit("id"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return align.assign_question_ids(p, q).select("pos", "qid")


@query("fifo_join", f"""WITH j AS (SELECT doc_id AS pos, lang AS model, {_ASKED} AS question, row_number() OVER (PARTITION BY lang, {_ASKED} ORDER BY doc_id) AS k FROM documents),
 p AS (SELECT CAST(doc_id AS VARCHAR) AS qid, lang AS model, {_KEY} AS question, row_number() OVER (PARTITION BY lang, {_KEY} ORDER BY doc_id) AS k FROM documents)
 SELECT pos, model, coalesce(qid, 'unknown::' || model || '::' || CAST(pos AS VARCHAR)) AS qid FROM j LEFT JOIN p USING (model, question, k)""")
def fifo_join(spark, sf):
    d = _docs(spark, sf).withColumn("answer", F.lit("")).withColumnRenamed("lang", "model")
    p = d.withColumn("qid", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "pos")
    asked = F.concat(F.lit("\t"), "question", F.when(F.col("doc_id") % 2 == 0, "? ").otherwise(" "))
    return align.fifo_question_ids(d.withColumn("question", asked).withColumnRenamed("doc_id", "pos"), p).select("pos", "model", "qid")


#: Judges of different lengths: places are ranks in a source, judge v1 lacks the last two, v2 the last one.
_LEN = f"""(SELECT model, judge, is_correct, p FROM (SELECT *, row_number() OVER (PARTITION BY model, judge ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY model, judge) AS c FROM {D.VOTES})
 WHERE p < c - CASE judge WHEN 'v1' THEN 2 WHEN 'v2' THEN 1 ELSE 0 END)"""


def _uneven(spark, sf):
    v = align.with_occurrence(D.votes_long(spark, sf), ["model", "judge"], ["pos"], "p").drop("pos")
    n = v.groupBy("model", "judge").agg(F.count("*").alias("c"))
    short = F.when(F.col("judge") == "v1", 2).when(F.col("judge") == "v2", 1).otherwise(0)
    return v.join(n, ["model", "judge"]).where(F.col("p") < F.col("c") - short).select("model", "judge", F.col("p").alias("pos"), "is_correct")


@query("judge_zip_minlen", f"""WITH m AS (SELECT model, min(n) AS n FROM (SELECT model, judge, max(p) + 1 AS n FROM {_LEN} GROUP BY model, judge) GROUP BY model)
 SELECT model, p::BIGINT AS pos, floor(avg(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0 END) * 100) / 100 AS score FROM {_LEN} JOIN m USING (model) WHERE p < m.n GROUP BY model, p""")
def judge_zip_minlen(spark, sf):
    return judge.mean_vote_long(align.zip_judges(_uneven(spark, sf)), ["model", "pos"])


@query("complete_models", f"""SELECT model, count(*) AS n FROM {D.VOTES} WHERE is_correct IS NOT NULL AND model IN (SELECT model FROM {D.VOTES} WHERE is_correct IS NOT NULL GROUP BY model HAVING count(DISTINCT judge) >= 3)
 AND model IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY model""")
def complete_models(spark, sf):
    v = D.votes_long(spark, sf).where("is_correct is not null")
    p = D.documents(spark, sf).where("lang = 'de'").select(F.col("source").alias("model"))
    return align.complete_models(v, p, 3).groupBy("model").agg(F.count("*").alias("n"))


@query("batching", "SELECT doc_id, (doc_id // 5)::BIGINT AS batch, (doc_id % 5 + 1)::BIGINT AS index FROM documents")
def batching(spark, sf):
    return align.batches(D.documents(spark, sf).select("doc_id"), 5, "doc_id")




def _responses(spark, sf):
    items = align.batches(D.documents(spark, sf).select("doc_id"), 5, "doc_id")
    size = 5 - F.col("batch") % 3
    return items, items.select("batch").distinct().withColumn("results", F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: i * 10))


@query("batch_response_zip", "SELECT doc_id, (doc_id // 5)::BIGINT AS batch, ((doc_id % 5 + 1) * 10)::BIGINT AS result FROM documents WHERE doc_id % 5 + 1 <= 5 - (doc_id // 5) % 3")
def batch_response_zip(spark, sf):
    items, got = _responses(spark, sf)
    return align.batch_zip(items, got).select("doc_id", "batch", "result")


@query("batch_lost_rows", "SELECT (doc_id // 5)::BIGINT AS batch, greatest(count(*) - (5 - (doc_id // 5) % 3), 0)::BIGINT AS lost FROM documents GROUP BY doc_id // 5")
def batch_lost_rows(spark, sf):
    items, got = _responses(spark, sf)
    return align.lost_rows(items, got)


@query("group_by_case", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def group_by_case(spark, sf):
    cases = align.group_ordered(table(spark, sf, "conversations"), "conv_id", "turn", ["role"], "turns")
    return cases.select("conv_id", F.array_join(F.transform("turns", lambda x: x["role"]), ">").alias("roles"))


#: Models of every fifth document are null.
_MODEL = "(CASE WHEN doc_id % 5 > 0 THEN lang END)"


@query("fifo_join_null_models", f"""WITH j AS (SELECT doc_id AS pos, {_MODEL} AS model, {_ASKED} AS question, row_number() OVER (PARTITION BY {_MODEL}, {_ASKED} ORDER BY doc_id) AS k FROM documents),
 p AS (SELECT CAST(doc_id AS VARCHAR) AS qid, {_MODEL} AS model, {_KEY} AS question, row_number() OVER (PARTITION BY {_MODEL}, {_KEY} ORDER BY doc_id) AS k FROM documents)
 SELECT pos, j.model, coalesce(qid, 'unknown::' || coalesce(j.model, '') || '::' || CAST(pos AS VARCHAR)) AS qid FROM j LEFT JOIN p ON j.model IS NOT DISTINCT FROM p.model AND j.question IS NOT DISTINCT FROM p.question AND j.k = p.k""")
def fifo_join_null_models(spark, sf):
    d = _docs(spark, sf).withColumn("answer", F.lit("")).withColumn("model", F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).withColumnRenamed("doc_id", "pos")
    asked = F.concat("question", F.when(F.col("pos") % 2 == 0, "?").otherwise(""))
    return align.fifo_question_ids(d.withColumn("question", asked), d.withColumn("qid", F.col("pos").cast("string"))).select("pos", "model", "qid")
