"""Curation of question-answer pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import normalize_image_id
from ..operators import curate
from ..session import table
from . import _data as D
from .registry import query


@query("qa_pairs", f"SELECT case_id, idx, question, answer FROM {D.PAIRS}")
def qa_pairs(spark, sf):
    return D.conversation_pairs(spark, sf)


@query("qid_assign", "SELECT conv_id AS case_id, turn AS idx, 'valid_' || CAST(conv_id AS VARCHAR) || '_a_1.nii.gz::' || CAST(turn AS VARCHAR) AS qid FROM conversations")
def qid_assign(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("idx"))
    image = normalize_image_id(F.concat(F.lit("x/valid_"), F.col("case_id").cast("string"), F.lit("_a_1.npy")))
    return c.withColumn("__case", image).select("case_id", "idx", F.concat("__case", F.lit("::"), F.col("idx").cast("string")).alias("qid"))


#: A document is a pair of its source's case; a label row is a judgment, toxic null for every fifth to exercise explicit nulls.
_LAB = """(SELECT d.doc_id, d.source AS case_id, l.doc_id IS NOT NULL AS has, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE l.quality = 1 END AS is_spatial, l.toxic = 0 AS is_relevant
 FROM documents d LEFT JOIN labels l USING (doc_id))"""
_REASON = f"""(SELECT *, CASE WHEN has AND NOT coalesce(is_spatial, false) THEN 'non_spatial' WHEN has AND NOT coalesce(is_relevant, false) THEN 'non_relevant' END AS reason FROM {_LAB})"""


def _labelled(spark, sf):
    pairs = D.documents(spark, sf).select("doc_id", F.col("source").alias("case_id"), F.col("doc_id").alias("idx"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.lit(True).alias("has_spatial"), F.lit(True).alias("has_relevant"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("is_spatial"), (F.col("toxic") == 0).alias("is_relevant"))
    labels = labels.join(pairs.select(F.col("idx").alias("pos"), "case_id"), "pos")
    return curate.label_pairs(pairs, labels)


@query("qa_filter", f"SELECT doc_id, case_id FROM {_REASON} WHERE reason IS NULL")
def qa_filter(spark, sf):
    return curate.filter_pairs(_labelled(spark, sf)).select("doc_id", "case_id")


@query("qa_filter_removed_counts", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM {_REASON} GROUP BY 1")
def qa_filter_removed_counts(spark, sf):
    return curate.removal_counts(_labelled(spark, sf))


@query("qa_filter_keep_flags", f"SELECT doc_id, CASE WHEN has AND NOT coalesce(is_relevant, false) THEN 'non_relevant' END AS reason FROM {_LAB}")
def qa_filter_keep_flags(spark, sf):
    return curate.removal_reason(_labelled(spark, sf), keep_nonspatial=True).select("doc_id", "reason")


_HOST = "split_part(split_part(url, '://', 2), '/', 1)"


def _pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("host"), F.col("url").alias("image_path"))


@query("image_map_first_wins", f"SELECT {_HOST} AS host, min_by(url, page_id) AS image_path FROM pages GROUP BY 1")
def image_map_first_wins(spark, sf):
    return curate.image_map(_pages(spark, sf), "host", "image_path", "page_id")


@query("image_map_last_wins", f"SELECT {_HOST} AS host, max_by(url, page_id) AS image_path FROM pages GROUP BY 1")
def image_map_last_wins(spark, sf):
    return curate.image_map(_pages(spark, sf), "host", "image_path", "page_id", keep="last")


@query("qa_export_skip_missing", f"""SELECT CAST(case_id AS VARCHAR) AS case_id, coalesce(p.url, b.text) AS image_path, question, answer FROM {D.PAIRS} q
 LEFT JOIN pages p ON CASE WHEN p.page_id % 2 = 0 THEN p.page_id ELSE -1 - p.page_id END = q.case_id LEFT JOIN benchmark b ON b.item_id = q.case_id WHERE coalesce(p.url, b.text) IS NOT NULL""")
def qa_export_skip_missing(spark, sf):
    pairs = D.conversation_pairs(spark, sf).withColumn("case_id", F.col("case_id").cast("string"))
    case = F.when(F.col("page_id") % 2 == 0, F.col("page_id")).otherwise(-1 - F.col("page_id"))  # odd pages belong to no case
    first = table(spark, sf, "pages").select(case.cast("string").alias("case_id"), F.col("url").alias("image_path"))
    second = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("image_path"))
    return curate.export_rows(curate.with_images(pairs, first, second, skip_missing=True))


@query("missing_map_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_map_anti(spark, sf):
    return curate.pending_cases(D.documents(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("report_join", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS findings_en, coalesce(CAST(l.toxic AS VARCHAR), '') AS impressions_en FROM documents d LEFT JOIN labels l USING (doc_id)")
def report_join(spark, sf):
    pairs = D.documents(spark, sf).select("doc_id", F.col("doc_id").alias("case_id"))
    reports = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").cast("string").alias("findings_en"), F.col("toxic").cast("string").alias("impressions_en"))
    return curate.with_reports(pairs, reports).select("doc_id", "findings_en", "impressions_en")


@query("replica_merge", """SELECT coalesce(a.doc_id, b.doc_id) AS idx, coalesce(b.lang, a.lang) AS lang FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) a
 FULL JOIN (SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 3 <> 1) b USING (doc_id)""")
def replica_merge(spark, sf):
    d = D.documents(spark, sf).select(F.col("source").alias("case_id"), F.col("doc_id").alias("idx"), "lang")
    return curate.merge_replicas(d.where("idx % 3 <> 0"), d.where("idx % 3 <> 1").withColumn("lang", F.upper("lang")), ["lang"]).select("idx", "lang")
