"""Alignment of predictions, judgments and questions where rows have no ids: by occurrence, by position, by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import normalize_image_id
from ..functions.text import first_truthy, normalize

#: Occurrences are numbered in blocks of 2^20 places.
BLOCK_BITS = 20


def with_occurrence(rows: DataFrame, keys: list[str], order: list[str], out: str = "occ", bits: int = BLOCK_BITS) -> DataFrame:
    """The 0-based occurrence number of each row among those with its key; null keys are equal to each other, ties in any order.

    If the first order column is an integer (a place), rows are numbered in blocks of 2^bits consecutive values of it, and a
    block's numbers begin behind those of its key's earlier blocks: a key with very many rows then is many tasks' work.
    """
    if not isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return rows.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    # the key as one struct: never null itself, so windows and the join hash the same columns and share one shuffle
    dealt = rows.withColumns({"__key": F.struct(*keys), "__block": F.shiftright(F.col(order[0]).cast("long"), bits)})
    dealt = dealt.withColumn("__block", F.coalesce("__block", F.lit(-(1 << 63))))
    earlier = W.partitionBy("__key").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("__key", "__block").agg(F.count("*").alias("__n"))
    before = sizes.select("__key", "__block", F.sum("__n").over(earlier).alias("__before")).where("__before is not null")
    number = F.row_number().over(W.partitionBy("__key", "__block").orderBy(*order)) - 1
    placed = dealt.withColumn("__at", number).join(before, ["__key", "__block"], "left")
    return placed.select(*rows.columns, (F.col("__at") + F.coalesce("__before", F.lit(0))).cast("long").alias(out))


def occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], values: list[str]) -> DataFrame:
    """Left rows with ``values`` of the right row that is the same occurrence of the same key (k-th with k-th), else nulls.

    Null keys are equal to each other: the join is on the keys as one struct.
    """
    a, b = with_occurrence(left, keys, left_order), with_occurrence(right, keys, right_order)
    key = F.struct(*keys).alias("__key")
    return a.select("*", key).join(b.select(key, "occ", *values), ["__key", "occ"], "left").select(*left.columns, "occ", *values)


def _keyed(rows: DataFrame) -> DataFrame:
    """Question and answer stripped, null being empty."""
    return rows.withColumns({c: normalize(c) for c in ("question", "answer")})


def assign_question_ids(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Predictions with ``qid`` by (image_id, question, answer) and occurrence; else ``image::pos`` or ``unknown::pos``.

    Questions and answers are compared stripped, null as empty.  A prediction's image (``image_id``, or else the first of
    ``case_id`` and ``image_path`` that is not empty) is brought to its volume's file name; none counts as empty.
    """
    if "image_id" not in predictions.columns:
        predictions = predictions.withColumn("image_id", first_truthy(*[c for c in ("case_id", "image_path") if c in predictions.columns]))
    image = F.when(F.coalesce("image_id", F.lit("")) != "", normalize_image_id("image_id")).otherwise(F.lit(""))
    got = occurrence_join(_keyed(predictions).withColumn("image_id", image), _keyed(questions), ["image_id", "question", "answer"], ["pos"], ["qid"], ["qid"])
    named = F.coalesce(F.nullif("image_id", F.lit("")), F.lit("unknown"))
    return got.withColumn("qid", F.coalesce("qid", F.concat(named, F.lit("::"), F.col("pos").cast("string")))).drop("occ")


def fifo_question_ids(judgments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Judgments with the ``qid`` of the first unused prediction of the same question and answer of their model.

    Images are ignored, as judgments carry none; texts are compared stripped, null as empty; null models are one model.  An
    unmatched row becomes ``unknown::model::pos``, with nothing for a null model.
    """
    got = occurrence_join(_keyed(judgments), _keyed(predictions), ["model", "question", "answer"], ["pos"], ["pos"], ["qid"])
    return got.withColumn("qid", F.coalesce("qid", F.concat(F.lit("unknown::"), F.coalesce("model", F.lit("")), F.lit("::"), F.col("pos").cast("string")))).drop("occ")


def zip_judges(votes: DataFrame) -> DataFrame:
    """Judge rows (``judge, model, pos``) cut to the shortest judge of each model."""
    lengths = votes.groupBy("model", "judge").agg((F.max("pos") + 1).alias("n")).groupBy("model").agg(F.min("n").alias("n"))
    return votes.join(lengths, "model").where("pos < n").drop("n")


def complete_models(votes: DataFrame, predictions: DataFrame, judges: int) -> DataFrame:
    """Votes of the models that every judge has judged and that have predictions."""
    full = votes.groupBy("model").agg(F.count_distinct("judge").alias("n")).where(F.col("n") >= judges).select("model")
    return votes.join(full.join(predictions.select("model").distinct(), "model"), "model", "left_semi")


def batches(rows: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """``batch`` and 1-based ``index`` of each place."""
    return rows.withColumn("batch", F.floor(F.col(pos) / size).cast("long")).withColumn("index", (F.col(pos) % size + 1).cast("long"))


def batch_zip(items: DataFrame, responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items with the response entry at their place in the batch; items beyond a short response are lost, as in a zip.

    ``responses`` has one array column ``results`` for each batch (columns ``keys``, default ``batch``).
    """
    keys = keys or ["batch"]
    flat = responses.select(*keys, F.posexplode("results").alias("__i", "result"))
    return items.join(flat.withColumn("index", (F.col("__i") + 1).cast("long")).drop("__i"), [*keys, "index"])


def lost_rows(items: DataFrame, responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per batch how many items a short response loses."""
    keys = keys or ["batch"]
    sizes = items.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.join(responses.select(*keys, F.size("results").alias("got")), keys, "left").select(*keys, F.greatest(F.col("n") - F.greatest(F.coalesce("got", F.lit(0)), F.lit(0)), F.lit(0)).cast("long").alias("lost"))


def group_ordered(rows: DataFrame, key: str, order: str, values: list[str], out: str = "rows") -> DataFrame:
    """One row a key with its rows as structs of ``values``, by ``order`` (nulls first); a case's rows have to fit into a task."""
    entry = F.struct(F.col(order).alias("__o"), *values)
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("__r"))
    return lists.select(key, F.transform("__r", lambda x: F.struct(*[x[v].alias(v) for v in values])).alias(out))
