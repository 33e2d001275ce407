"""Votes, juries, correctness matrices, leaderboards and category performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import floor2, ratio

THRESHOLD = 0.66


def mean_vote(votes: list[str | Column]) -> Column:
    """Share of judges that said true (null and false count as wrong), floored to two decimals."""
    right = [F.when(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)) for v in votes]
    total = right[0]
    for r in right[1:]:
        total = total + r
    return floor2(total / float(len(votes)))


def mean_vote_long(votes: DataFrame, keys: list[str], vote: str = "is_correct") -> DataFrame:
    """The same from one row a judge."""
    return votes.groupBy(*keys).agg(floor2(F.avg(F.when(F.col(vote), 1.0).otherwise(0.0))).alias("score"))


def missing_scores(scores: DataFrame, missing: str, score: str = "score") -> DataFrame:
    """Missing scores are left out ("skip") or count as zero ("zero")."""
    if missing == "zero":
        return scores.withColumn(score, F.coalesce(score, F.lit(0.0)))
    if missing != "skip":
        raise ValueError("missing is skip or zero")
    return scores.where(F.col(score).isNotNull())


def jury_accuracy(scores: DataFrame, threshold: float = THRESHOLD, missing: str = "skip") -> DataFrame:
    """``(model, accuracy, n)`` of thresholded scores."""
    passed = F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)
    return missing_scores(scores, missing).groupBy("model").agg(F.avg(passed).alias("accuracy"), F.count("*").alias("n"))


def single_judge_accuracy(votes: DataFrame, keys: list[str], vote: str = "is_correct") -> DataFrame:
    """Accuracy over non-null verdicts, 0.0 if there are none; with counts."""
    right, total = F.count_if(F.col(vote)), F.count(vote)
    return votes.groupBy(*keys).agg(ratio(right, total).alias("accuracy"), right.alias("correct"), total.alias("judged"))


def majority(votes: DataFrame, keys: list[str], vote: str = "is_correct") -> DataFrame:
    """True if true votes are no fewer than false ones (a tie is correct); null without votes."""
    t, f = F.count_if(F.col(vote)), F.count_if(~F.col(vote))
    return votes.groupBy(*keys).agg(t.alias("votes_true"), f.alias("votes_false")).withColumn("jury_is_correct", F.when(F.col("votes_true") + F.col("votes_false") > 0, F.col("votes_true") >= F.col("votes_false")))


def correctness(scores: DataFrame, order: str = "pos") -> DataFrame:
    """One score a (question, model): of repeated ones the last by ``order`` counts."""
    return scores.groupBy("question_id", "model").agg(F.max_by("score", order).alias("score"))


def model_names(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("model")
    for f in frames[1:]:
        out = out.union(f.select("model"))
    return out.distinct().orderBy("model")


def category_performance(scores: DataFrame, categories: DataFrame, binarize: bool = False, threshold: float = THRESHOLD, missing: str = "zero") -> DataFrame:
    """``(category, model, pct, n)``: mean score in percent of each label and model.

    ``categories`` has an array column ``category``; a question counts under every label, also under a repeated one, and a
    question without labels is left out.  ``n`` counts the label's matrix rows, not the denominator of the mean.
    """
    labelled = scores.join(categories.select("question_id", "category"), "question_id").select("model", "score", F.explode("category").alias("category"))
    s = F.coalesce("score", F.lit(0.0)) if missing == "zero" else F.col("score")
    value = F.when(s.isNotNull(), F.when(s >= threshold, 1.0).otherwise(0.0)) if binarize else s
    return labelled.groupBy("category", "model").agg((F.avg(value) * 100.0).alias("pct"), F.count("*").alias("n"))


def disagreements(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Counts of rows where two raters differ, by direction; nulls on either side are no disagreement."""
    d = rows.where(F.col(a) != F.col(b)).withColumn("direction", F.when(F.col(a), F.lit(f"{a}_only")).otherwise(F.lit(f"{b}_only")))
    return d.groupBy(*keys, "direction").agg(F.count("*").alias("n"))


def progress(answers: DataFrame) -> DataFrame:
    """Per (user, case) answered and total counts with a status; ``answers`` has user, case and a boolean ``answered``."""
    by_case = answers.groupBy("user", "case").agg(F.count_if("answered").alias("answered"), F.count("*").alias("total"))
    return by_case.withColumn("status", F.when(F.col("answered") == 0, "not_started").when(F.col("answered") < F.col("total"), "in_progress").otherwise("complete"))


def user_progress(cases: DataFrame) -> DataFrame:
    """Per user: cases, complete cases, answered share, and a status from the cases."""
    out = cases.groupBy("user").agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "not_started").alias("idle"), F.sum("answered").alias("answered"), F.sum("total").alias("total"))
    status = F.when(F.col("complete") == F.col("cases"), "complete").when(F.col("idle") == F.col("cases"), "not_started").otherwise("in_progress")
    return out.select("user", "cases", "complete", "answered", "total", (ratio(F.col("answered"), F.col("total")) * 100).alias("pct"), status.alias("status"))
