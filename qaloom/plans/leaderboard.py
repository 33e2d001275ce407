"""Judges, juries and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge
from ..sources.sinks import matrix_wide
from . import _data as D
from .registry import query

MODELS = [f"src{i}" for i in range(20)]


def _scores(spark, sf):
    return D.labelled(spark, sf).withColumn("score", judge.mean_vote(["v1", "v2", "v3"]))


@query("jury_accuracy", f"SELECT model, avg(CASE WHEN score >= 0.66::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM {D.SCORED} GROUP BY model")
def jury_accuracy(spark, sf):
    return judge.jury_accuracy(_scores(spark, sf))


@query("jury_mean_vote", f"SELECT model, pos, score FROM {D.SCORED}")
def jury_mean_vote(spark, sf):
    return judge.mean_vote_long(D.votes_long(spark, sf), ["model", "pos"])


#: A judge's missing row makes the score null here, so that both policies differ.
_PARTIAL = f"(SELECT model, pos, CASE WHEN v1 IS NULL THEN NULL ELSE score END AS score FROM {D.SCORED})"


def _partial(spark, sf):
    return _scores(spark, sf).withColumn("score", F.when(F.col("v1").isNotNull(), F.col("score")))


@query("jury_accuracy_missing_skip", f"SELECT model, avg(CASE WHEN score >= 0.66::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM {_PARTIAL} WHERE score IS NOT NULL GROUP BY model")
def jury_accuracy_missing_skip(spark, sf):
    return judge.jury_accuracy(_partial(spark, sf), missing="skip")


@query("jury_accuracy_missing_zero", f"SELECT model, avg(CASE WHEN coalesce(score, 0) >= 0.66::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM {_PARTIAL} GROUP BY model")
def jury_accuracy_missing_zero(spark, sf):
    return judge.jury_accuracy(_partial(spark, sf), missing="zero")


@query("single_judge_accuracy", f"""SELECT model, judge, CASE WHEN count(is_correct) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (is_correct)::DOUBLE / count(is_correct) END AS accuracy,
 count(*) FILTER (is_correct) AS correct, count(is_correct) AS judged FROM {D.VOTES} GROUP BY model, judge""")
def single_judge_accuracy(spark, sf):
    return judge.single_judge_accuracy(D.votes_long(spark, sf), ["model", "judge"])


@query("jury_majority_tie", f"""SELECT model, pos, count(*) FILTER (is_correct) AS votes_true, count(*) FILTER (NOT is_correct) AS votes_false,
 CASE WHEN count(is_correct) > 0 THEN count(*) FILTER (is_correct) >= count(*) FILTER (NOT is_correct) END AS jury_is_correct
 FROM {D.VOTES} WHERE judge <> 'v3' GROUP BY model, pos""")
def jury_majority_tie(spark, sf):
    return judge.majority(D.votes_long(spark, sf).where("judge <> 'v3'"), ["model", "pos"])


_MATRIX = f"(SELECT question_id, model, max_by(score, pos) AS score FROM {D.SCORED} GROUP BY question_id, model)"


@query("correctness_matrix_long", f"SELECT * FROM {_MATRIX}")
def correctness_matrix_long(spark, sf):
    return judge.correctness(_scores(spark, sf))


@query("correctness_matrix_wide", "SELECT question_id, " + ", ".join(f"coalesce(format('{{:.2f}}', max(CASE WHEN model = '{m}' THEN score END)), '') AS {m}" for m in MODELS) + f" FROM {_MATRIX} GROUP BY question_id")
def correctness_matrix_wide(spark, sf):
    return matrix_wide(judge.correctness(_scores(spark, sf)), MODELS)


def _category(spark, sf, **kw):
    scores = _partial(spark, sf).select(F.col("pos").alias("question_id"), "model", "score")
    out = judge.category_performance(scores, D.categories(spark, sf), **kw)
    return out.withColumn("pct", F.round("pct", 6))


@query("category_performance", f"SELECT category, model, round(avg(coalesce(score, 0)) * 100, 6) AS pct, count(*) AS n FROM {_PARTIAL} p JOIN {D.CATEGORIES} c ON p.pos = c.question_id GROUP BY category, model")
def category_performance(spark, sf):
    return _category(spark, sf)


@query("category_performance_skip", f"SELECT category, model, round(avg(score) * 100, 6) AS pct, count(*) AS n FROM {_PARTIAL} p JOIN {D.CATEGORIES} c ON p.pos = c.question_id GROUP BY category, model")
def category_performance_skip(spark, sf):
    return _category(spark, sf, missing="skip")


@query("category_performance_binarized", f"SELECT category, model, round(avg(CASE WHEN coalesce(score, 0) >= 0.66::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct, count(*) AS n FROM {_PARTIAL} p JOIN {D.CATEGORIES} c ON p.pos = c.question_id GROUP BY category, model")
def category_performance_binarized(spark, sf):
    return _category(spark, sf, binarize=True)


@query("label_agreement", f"SELECT model, CASE WHEN v1 THEN 'v1_only' ELSE 'v3_only' END AS direction, count(*) AS n FROM {D.LABELLED} WHERE v1 <> v3 GROUP BY 1, 2")
def label_agreement(spark, sf):
    return judge.disagreements(D.labelled(spark, sf), "v1", "v3", ["model"])


_CASES = """(SELECT user, "case", count(*) FILTER (answered) AS answered, count(*) AS total, CASE WHEN count(*) FILTER (answered) = 0 THEN 'not_started' WHEN count(*) FILTER (answered) < count(*) THEN 'in_progress' ELSE 'complete' END AS status
 FROM (SELECT 'u' || CAST(conv_id % 7 AS VARCHAR) AS user, conv_id AS "case", length(text) % 3 <> 0 AS answered FROM conversations) GROUP BY user, "case")"""


def _answers(spark, sf):
    from ..session import table

    c = table(spark, sf, "conversations")
    return c.select(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user"), F.col("conv_id").alias("case"), (F.length("text") % 3 != 0).alias("answered"))


@query("progress_cases", f"SELECT * FROM {_CASES}")
def progress_cases(spark, sf):
    return judge.progress(_answers(spark, sf))


@query("progress_rollup", f"""SELECT user, count(*) AS cases, count(*) FILTER (status = 'complete') AS complete, sum(answered)::BIGINT AS answered, sum(total)::BIGINT AS total,
 CASE WHEN sum(total) = 0 THEN 0.0 ELSE sum(answered)::DOUBLE / sum(total)::DOUBLE END * 100 AS pct,
 CASE WHEN count(*) FILTER (status = 'complete') = count(*) THEN 'complete' WHEN count(*) FILTER (status = 'not_started') = count(*) THEN 'not_started' ELSE 'in_progress' END AS status FROM {_CASES} GROUP BY user""")
def progress_rollup(spark, sf):
    return judge.user_progress(judge.progress(_answers(spark, sf)))


@query("model_union", "SELECT DISTINCT source AS model FROM documents")
def model_union(spark, sf):
    v = D.labelled(spark, sf)
    return judge.model_names(v.where("v1"), v.where("v1 is null or not v1"))
