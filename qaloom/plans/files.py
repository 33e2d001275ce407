"""File round trips: whole tables written in a reference format to the shared folder, and read back.

Every call has a folder of its own, which goes once its rows have been read back; two calls never meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import folder_of_its_own, settled, table
from ..sources import datasources, files, sinks, volumes
from . import _data as D
from .registry import query


#: Columns of a matrix at most; more models than that are no wide table.
MOST_MODELS = 10_000


def _files(f: Callable) -> Callable:
    """``f(spark, sf, at)`` as a query: ``at`` is a new folder that is gone when the query returns."""

    @wraps(f)
    def run(spark, sf) -> DataFrame:
        with folder_of_its_own(spark, f.__name__) as at:
            return settled(f(spark, sf, at))

    return run


@query("reports_csv_files", "SELECT CAST(doc_id AS VARCHAR) AS file_name, md5(coalesce(text, '')) AS findings, coalesce(source, '') AS impressions FROM documents")
@_files
def reports_csv_files(spark, sf, at):
    sinks.write_reports_csv(D.documents(spark, sf).select(F.col("doc_id").cast("string").alias("file_name"), F.col("text").alias("findings_en"), F.col("source").alias("impressions_en")), at)
    return files.read_reports_csv(spark, at).select("file_name", F.md5(F.col("findings_en").cast("binary")).alias("findings"), F.col("impressions_en").alias("impressions"))


_QA = f"SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY idx) - 1 AS INT) AS idx, question, answer FROM {D.PAIRS}"


@query("qa_map_files", _QA)
@_files
def qa_map_files(spark, sf, at):
    sinks.write_qa(D.conversation_pairs(spark, sf), at)
    return files.read_qa(spark, at).select("case_id", "idx", "question", "answer")


@query("qa_list_files", _QA)
@_files
def qa_list_files(spark, sf, at):
    sinks.write_qa(D.conversation_pairs(spark, sf), at, as_list=True)
    return files.read_qa(spark, at).select("case_id", "idx", "question", "answer")


@query("jsonl_strict_files", "SELECT CAST(doc_id AS VARCHAR) AS case_id, source AS question, lang AS answer, md5(text) AS prediction, true AS dense FROM documents")
@_files
def jsonl_strict_files(spark, sf, at):
    sinks.write_jsonl(D.documents(spark, sf).select(F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("question"), F.col("lang").alias("answer"), F.col("text").alias("prediction")), at, ["case_id"])
    got = files.read_jsonl(spark, at, schemas.PREDICTION)
    sizes = got.groupBy("model").agg((F.count_distinct("pos") == F.max("pos") + 1).alias("dense"))
    return got.join(sizes, "model").select("case_id", "question", "answer", F.md5(F.col("prediction").cast("binary")).alias("prediction"), "dense")


def _noisy(spark, sf, at: str) -> str:
    """Events as JSON lines; a broken line stands behind every seventh, beside the rows and not in place of one."""
    row = F.to_json(F.struct(F.col("event_id").cast("string").alias("case_id"), F.col("props").alias("question")))
    lines = F.when(F.col("event_id") % 7 == 0, F.array(row, F.concat(F.lit("{oops"), "props"), F.lit(" "))).otherwise(F.array(row))
    table(spark, sf, "events").select(F.explode(lines).alias("value")).write.mode("overwrite").text(at)
    return at


_EVENTS = "SELECT CAST(event_id AS VARCHAR) AS case_id, props AS question FROM events"


@query("jsonl_lenient_files", _EVENTS)
@_files
def jsonl_lenient_files(spark, sf, at):
    return files.read_jsonl(spark, _noisy(spark, sf, at), schemas.PREDICTION, strict=False).select("case_id", "question")


@query("json_or_lines_files", _EVENTS)
@_files
def json_or_lines_files(spark, sf, at):
    return files.read_json_or_lines(spark, _noisy(spark, sf, at), schemas.PREDICTION).select("case_id", "question")


_JUDGED = "SELECT CAST(doc_id AS VARCHAR) AS case_id, source AS question, lang AS answer, quality = 1 AS is_correct FROM documents LEFT JOIN labels USING (doc_id)"


def _judged(spark, sf, at: str, box: str | None):
    """Judgments in list files, or in files with a ``jury`` or ``items`` box; a jury's verdict stands in a field of its own."""
    verdict = F.col("quality") == 1
    rows = D.documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("question"), F.col("lang").alias("answer"), (~verdict if box == "jury" else verdict).alias("is_correct"), verdict.alias("jury_is_correct"))
    sinks.write_boxed(rows, at, lambda r: F.struct(r.alias(box)) if box else r)
    return files.read_judge(spark, at, "gpt").select("case_id", "question", "answer", "is_correct")


@query("judge_list_files", _JUDGED)
@_files
def judge_list_files(spark, sf, at):
    return _judged(spark, sf, at, None)


@query("judge_jury_files", _JUDGED)
@_files
def judge_jury_files(spark, sf, at):
    return _judged(spark, sf, at, "jury")


@query("judge_item_files", _JUDGED)
@_files
def judge_item_files(spark, sf, at):
    return _judged(spark, sf, at, "items")


@query("matrix_files", """SELECT CAST(doc_id AS VARCHAR) AS question_id, m.lang AS model, CASE WHEN d.lang = m.lang THEN (n_chars % 101) / 100.0::DOUBLE END AS score
 FROM documents d, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) m""")
@_files
def matrix_files(spark, sf, at):
    d = D.documents(spark, sf).select(F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("model"), ((F.col("n_chars") % 101) / 100).alias("score"))
    models = [r[0] for r in d.where("model is not null").select("model").distinct().orderBy("model").limit(MOST_MODELS + 1).collect()]
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models: keep the scores long")
    sinks.write_csv(sinks.matrix_wide(d, models), at)
    return files.read_matrix(spark, at)


@query("raw_line_window", """WITH e AS (SELECT event_id, event_type, row_number() OVER w - 1 AS p, count(*) FILTER (event_id % 7 = 0) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blanks FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
 SELECT event_type, event_id, p + blanks AS raw FROM e WHERE p + blanks >= 31 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY p) <= 250""")
@_files
def raw_line_window(spark, sf, at):
    """A file an event type, a blank line behind every seventh event; of each 31 lines skipped, blank ones counted, then 250 others."""
    rows = table(spark, sf, "events").select("event_type", "event_id", F.to_json(F.struct("event_id")).alias("row")).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    lines = rows.select("event_type", F.explode(F.when(F.col("event_id") % 7 == 0, F.array("row", F.lit(" "))).otherwise(F.array("row"))).alias("value"))
    lines.write.partitionBy("event_type").text(at)
    kept = files.window_lines(files.numbered_lines(spark, at), 31, 250)
    return kept.select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type"), F.from_json("line", "event_id long")["event_id"].alias("event_id"), "raw")


_TENSORS = "SELECT CAST(vec_id AS VARCHAR) AS name, '4,4,4' AS shape, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * i)), 4) AS total FROM embeddings"


def _tensors(spark, sf, at: str, kind: str):
    """Every vector as a file of 4 x 4 x 4 voxels, written with one commit."""
    datasources.register(spark)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("case_id"), F.array(*[F.lit(4)] * 3).alias("shape"), F.col("embedding").cast("array<float>").alias("data"))
    rows.write.format("tensors").mode("append").option("kind", kind).save(at)


def _weighed_tensor(name, shape, data):
    total = F.aggregate(F.transform(data, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.split(name, r"\.")[0].alias("name"), F.array_join(shape.cast("array<string>"), ",").alias("shape"), F.round(total, 4).alias("total")


@query("nifti_files", _TENSORS)
@_files
def nifti_files(spark, sf, at):
    _tensors(spark, sf, at, "nii.gz")
    got = spark.read.format("nifti").load(at)
    return got.select(*_weighed_tensor(F.col("case_id"), F.col("shape"), F.col("data")))


@query("nifti_depths", "SELECT CAST(vec_id AS VARCHAR) AS name, 4 AS depth, true AS header_alone FROM embeddings")
@_files
def nifti_depths(spark, sf, at):
    _tensors(spark, sf, at, "nii")
    got = spark.read.format("nifti").option("voxels", "false").load(at)
    return got.select(F.split("case_id", r"\.")[0].alias("name"), F.col("shape")[0].alias("depth"), F.col("data").isNull().alias("header_alone"))


@query("tensor_files", _TENSORS)
@_files
def tensor_files(spark, sf, at):
    _tensors(spark, sf, at, "npz")
    read = spark.read.format("binaryFile").load(f"{at}/*.npz").select(F.element_at(F.split("path", "/"), -1).alias("name"), volumes.decode_tensor("content", rank=3).alias("t"))
    return read.select(*_weighed_tensor(F.col("name"), F.col("t.shape"), F.col("t.data")))
