"""File sources that keep order explicit: CSV, JSON maps and lists, JSON lines (strict and lenient), judge and matrix files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import PREDICTION_SUFFIXES, first_truthy, model_of_file, strip
from .json_splits import elements, head_of_files, named


def read_reports_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report rows; a missing column or value reads as empty."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in schemas.REPORTS_CSV.names])


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: every file as one string; for small files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _last_of_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of a file's repeated keys the last one counts."""
    return rows.groupBy("path", key).agg(F.max_by(value, "pos").alias(value))


def read_reports_json(spark: SparkSession, path: str) -> DataFrame:
    """Reports of maps from case to report; a large file is read by many tasks."""
    pairs = elements(spark, path).select("path", "pos", F.explode(named(F.col("text"), schemas.REPORTS_JSON.valueType.simpleString())).alias("case_id", "r"))
    rows, empty = _last_of_each(pairs, "case_id", "r"), F.lit("")
    return rows.select("case_id", F.coalesce("r.Findings_EN", empty).alias("findings_en"), F.coalesce("r.Impressions_EN", empty).alias("impressions_en"))


def qa_pairs_of(cases: DataFrame, pairs: str = "qa_pairs") -> DataFrame:
    """Flat ``(case_id, idx, question, answer, error, raw_output)`` from one row a case."""
    return cases.select("case_id", F.posexplode(pairs).alias("idx", "p")).select("case_id", "idx", "p.*")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """QA pairs of a case map or of a list of cases.

    List entries are keyed by the first non-empty of case_id, file_name and case; those without a key go, and of repeated
    keys the last entry counts.
    """
    entry = schemas.QA_LIST.elementType
    each = elements(spark, path).withColumn("__map", F.col("text").rlike(r'^\s*"'))
    kind = schemas.QA_MAP.valueType.simpleString()
    as_map = each.where("__map").select("path", "pos", F.explode(named(F.col("text"), kind)).alias("case_id", "c")).select("path", "pos", "case_id", "c.qa_pairs")
    listed = each.where("not __map").select("path", "pos", F.from_json("text", entry).alias("e"))
    keyed = listed.select("path", "pos", first_truthy("e.case_id", "e.file_name", "e.case").alias("case_id"), "e.qa_pairs").where("case_id is not null")
    return qa_pairs_of(_last_of_each(as_map.unionByName(keyed), "case_id", "qa_pairs").select("case_id", "qa_pairs"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, raw, line)``: a file's non-blank lines with their 0-based places among these and among all lines.

    A long file is read by many tasks.  Row ids grow inside a split, so a line's place is its id less the split's first one, plus the
    lines of the file's earlier splits.  The table of splits has one row for each, and a file's window holds its splits alone.
    """
    every = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.col("value").alias("line")).withColumn("__raw", F.monotonically_increasing_id())
    lines = every.where(strip("line") != "").withColumn("__id", F.monotonically_increasing_id())
    earlier = lambda c: F.coalesce(F.sum(c).over(W.partitionBy("path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    raw = every.groupBy("path", "__block").agg(F.min("__raw").alias("__raw0"), F.count("*").alias("__m"))
    full = lines.groupBy("path", "__block").agg(F.min("__id").alias("__id0"), F.count("*").alias("__n"))
    splits = raw.join(full, ["path", "__block"], "left").na.fill(0, ["__n"])
    splits = splits.select("path", "__block", (F.col("__raw0") - earlier("__m")).alias("__raw0"), (F.col("__id0") - earlier("__n")).alias("__id0"))
    return lines.join(splits, ["path", "__block"]).select("path", (F.col("__id") - F.col("__id0")).alias("pos"), (F.col("__raw") - F.col("__raw0")).alias("raw"), "line")


def window_lines(lines: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Of ``numbered_lines`` those behind a file's first ``skip`` lines, blank ones counted, and of these ``limit`` that are not blank."""
    out = lines.where(F.col("raw") >= skip)
    if limit is None:
        return out
    first = out.groupBy("path").agg(F.min("pos").alias("__first"))
    return out.join(first, "path").where(F.col("pos") < F.col("__first") + limit).drop("__first")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON-lines rows with ``model`` (file name) and ``pos`` (0-based place among the file's non-blank lines).

    Strict: a malformed line raises.  Lenient: it is skipped, but still counts as a place.
    """
    lines = numbered_lines(spark, path)
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("r", F.from_json("line", schema if strict else full, mode))
    if not strict:
        parsed = parsed.where("r is not null and r._corrupt is null")
    return parsed.select(model_of_file("path").alias("model"), F.col("pos").cast("long").alias("pos"), *[F.col(f"r.{c}") for c in schema.names])


def read_json_or_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON list, or else JSON lines with bad lines skipped.  Either is read by as many tasks as the file's size asks for."""
    rows = elements(spark, path).join(head_of_files(spark, path).where("head = '['").select("path"), "path").select("path", "pos", F.from_json("text", schema).alias("r"))
    lines = numbered_lines(spark, path).join(head_of_files(spark, path).where("head <> '['").select("path"), "path")
    lines = lines.where(F.try_parse_json("line").isNotNull()).select("path", "pos", F.from_json("line", schema).alias("r"))
    both = rows.unionByName(lines).where("r is not null")
    return both.select(model_of_file("path").alias("model"), F.col("pos").cast("long").alias("pos"), "r.*")


def sniff_format(value: Column) -> Column:
    """jsonl if the text starts with an object, else json."""
    return F.when(F.ltrim(value).startswith("{"), F.lit("jsonl")).otherwise(F.lit("json"))


def read_judge(spark: SparkSession, path: str, judge: str) -> DataFrame:
    """``(judge, model, pos, case_id, question, answer, prediction, is_correct, reasoning)`` of a judge's files.

    A file is a list, ``{"jury": [...]}`` (verdict in ``jury_is_correct``) or ``{"items": [...]}``; any other file is empty.
    """
    item = T.StructType([*schemas.JUDGMENT.fields, T.StructField("jury_is_correct", T.BooleanType())])
    each = elements(spark, path, boxes=True).where("key in ('', 'jury', 'items')")
    # of a file with both lists the jury counts
    jury = each.where("key = 'jury'").select("path").distinct().withColumn("__jury", F.lit(True))
    rows = each.join(jury, "path", "left").where("__jury is null or key = 'jury'").select("path", "pos", F.coalesce("__jury", F.lit(False)).alias("__jury"), F.from_json("text", item).alias("r"))
    verdict = F.when(F.col("__jury"), F.col("r.jury_is_correct")).otherwise(F.col("r.is_correct"))
    return rows.select(F.lit(judge).alias("judge"), model_of_file("path").alias("model"), F.col("pos").cast("long").alias("pos"), "r.case_id", "r.question", "r.answer", "r.prediction", verdict.alias("is_correct"), "r.reasoning")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(case_id, pos, has_spatial, is_spatial, has_relevant, is_relevant, reasoning)``: missing and null stay apart."""
    each = elements(spark, path).select("path", "pos", F.explode(named(F.col("text"), "array<string>")).alias("case_id", "js"))
    rows = _last_of_each(each, "case_id", "js").select("case_id", F.posexplode("js").alias("pos", "j"))
    keys, got = F.json_object_keys("j"), F.from_json("j", schemas.LABEL)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return rows.select("case_id", "pos", has("is_spatial").alias("has_spatial"), got["is_spatial"].alias("is_spatial"), has("is_relevant").alias("has_relevant"), got["is_relevant"].alias("is_relevant"), got["reasoning"].alias("reasoning"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long ``(question_id, model, score)`` of a wide matrix; empty cells are null.  The header must start with question_id."""
    raw = spark.read.option("header", True).csv(path)
    if not raw.columns:
        raise ValueError("the matrix is empty")
    if raw.columns[0] != "question_id":
        raise ValueError("the first column must be question_id")
    if len(raw.columns) == 1:
        return raw.select("question_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("score")).where("false")
    long = raw.unpivot("question_id", raw.columns[1:], "model", "cell")
    return long.select("question_id", "model", F.nullif(F.trim("cell"), F.lit("")).cast("double").alias("score"))


def read_length_series(spark: SparkSession, path: str) -> DataFrame:
    """``(label, pos, n_words, include_questions)`` of precomputed series: one list of lengths a label, kept in order."""
    whole = read_whole(spark, path).select(F.from_json("value", schemas.LENGTH_SERIES).alias("s"))
    each = whole.select("s.include_questions", F.explode(F.arrays_zip(F.col("s.labels").alias("label"), F.col("s.series").alias("lengths"))).alias("x"))
    return each.select(F.col("x.label").alias("label"), F.posexplode("x.lengths").alias("pos", "n_words"), "include_questions")


def list_volumes(spark: SparkSession, root: str, pattern: str = "*.nii.gz") -> DataFrame:
    """``(name, path)`` of every matching file below ``root``; of equal names the last path counts.  Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return found.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.max("path").alias("path"))


def pick_prediction_file(files: DataFrame, model: str) -> DataFrame:
    """Of ``files`` (column ``name``) the first existing of a model's candidate names: for each spelling ``_full``, then plain."""
    stems = list(dict.fromkeys([model, model.replace("-", "_"), model.replace("_", "-")]))
    names = [s + x for s in stems for x in PREDICTION_SUFFIXES]
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name"))
    found = files.select(F.struct(*files.columns).alias("file"), rank.alias("rank")).where("rank > 0")
    return found.agg(F.min_by("file", "rank").alias("file")).where("file is not null").select("file.*")


def catalog_batches(catalog: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Batches of ``size`` names for a download catalogue that has a place column ``order``."""
    return catalog.withColumn("batch", F.floor(F.col(order) / size).cast("long"))
