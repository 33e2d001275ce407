"""Curation of question-answer pairs: label joins, keep rules, image maps and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import question_id


def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the label at the same place in their case (labels carry ``pos``, ``has_*`` and nullable ``is_*``)."""
    return pairs.join(labels.withColumnRenamed("pos", "idx"), ["case_id", "idx"], "left")


def keeps(has: str | Column, value: str | Column) -> Column:
    """A missing label keeps a pair, an explicit null or false drops it."""
    h = F.col(has) if isinstance(has, str) else has
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.coalesce(h, F.lit(False)), F.lit(True)).otherwise(F.coalesce(v, F.lit(False)))


def removal_reason(labelled: DataFrame, keep_nonspatial: bool = False, keep_nonrelevant: bool = False) -> DataFrame:
    """Adds ``reason``: non_spatial before non_relevant, null for a kept pair."""
    spatial, relevant = keeps("has_spatial", "is_spatial"), keeps("has_relevant", "is_relevant")
    reason = F.lit(None).cast("string")
    if not keep_nonrelevant:
        reason = F.when(~relevant, F.lit("non_relevant")).otherwise(reason)
    if not keep_nonspatial:
        reason = F.when(~spatial, F.lit("non_spatial")).otherwise(reason)
    return labelled.withColumn("reason", reason)


def filter_pairs(labelled: DataFrame, **flags: bool) -> DataFrame:
    """Kept pairs; a case without any left is gone by itself."""
    return removal_reason(labelled, **flags).where("reason is null").drop("reason")


def removal_counts(labelled: DataFrame, **flags: bool) -> DataFrame:
    return removal_reason(labelled, **flags).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def valid_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with a question and an answer, the others) so that error placeholders are set aside at ingest."""
    ok = F.col("question").isNotNull() & F.col("answer").isNotNull()
    return pairs.where(ok), pairs.where(~ok)


def uncategorized(pairs: DataFrame) -> DataFrame:
    """Pairs whose category is null; an empty list counts as done."""
    return pairs.where(F.col("category").isNull())


def allowed_models(rows: DataFrame, models: list[str] | None, column: str = "model") -> DataFrame:
    """Rows of the listed models; None allows all."""
    return rows if models is None else rows.where(F.col(column).isin(models))


def image_map(rows: DataFrame, key: str, path: str, order: str, keep: str = "first") -> DataFrame:
    """One path a key: the first or last by ``order``."""
    pick = F.min_by if keep == "first" else F.max_by
    return rows.groupBy(key).agg(pick(path, order).alias(path))


def with_images(pairs: DataFrame, primary: DataFrame, fallback: DataFrame | None = None, skip_missing: bool = False) -> DataFrame:
    """Pairs with ``image_path`` from the primary map, else the fallback map; a case in neither is dropped or raises.

    Maps have one row a ``case_id``, so the join cannot multiply pairs; Spark broadcasts a map only under its own size check.
    """
    out = pairs.join(primary.select("case_id", F.col("image_path").alias("__a")), "case_id", "left")
    path = F.col("__a")
    if fallback is not None:
        out = out.join(fallback.select("case_id", F.col("image_path").alias("__b")), "case_id", "left")
        path = F.coalesce("__a", "__b")
    out = out.withColumn("image_path", path).drop("__a", "__b")
    if skip_missing:
        return out.where("image_path is not null")
    return out.withColumn("image_path", F.coalesce("image_path", F.raise_error(F.concat(F.lit("no image for "), "case_id")).cast("string")))


def export_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select("case_id", "image_path", "question", "answer")


def with_reports(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    out = pairs.join(reports, "case_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("findings_en", "impressions_en")})


def pending_cases(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.join(done.select(key).distinct(), key, "left_anti")


def with_question_ids(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("qid", question_id("case_id", "idx"))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """(case_id, idx, question, answer): each user turn with the next assistant turn of its conversation.

    One sort a conversation, latest turn first, with a running last answer: linear in the turns and never held as a list.
    """
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(W.unboundedPreceding, -1)
    said = F.when(F.col("role") == "assistant", F.col("text"))
    out = turns.select("conv_id", "turn", "role", "text", F.last(said, ignorenulls=True).over(w).alias("answer"))
    return out.where("role = 'user' and answer is not null").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("idx"), F.col("text").alias("question"), "answer")


def merge_replicas(ours: DataFrame, replica: DataFrame, columns: list[str]) -> DataFrame:
    """Cases of both sides by (case_id, idx); where both have a pair the replica's counts."""
    both = ours.select("case_id", "idx", *[F.col(c).alias(f"__o_{c}") for c in columns]).join(replica.select("case_id", "idx", F.lit(True).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in columns]), ["case_id", "idx"], "full")
    return both.select("case_id", "idx", *[F.when(F.col("__r"), F.col(f"__r_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in columns])
