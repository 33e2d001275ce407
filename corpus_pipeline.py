"""From raw documents to packed training sequences: five stages, each one operator of ``qaloom.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result to the cluster's shared folder and reads it back.

Every stage takes null and empty texts, null and repeated ids, repeated rows and empty tables.  Rows that share an id are judged
each by itself; equal rows meet the same verdict, but of near copies (and so of equal rows) one stays, the smallest id first,
null last, then the smallest digest of all columns.  Columns beside ``text`` and ``doc_id`` are carried along whatever their names;
a column ``n_chars`` is brought up to date with the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm import gam, line_quality, simhash_sets, suffix_dedup
from qaloom.llm.common import drop, scratch, stage
from qaloom.llm.queries import packed
from qaloom.session import ready


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` in the order of ``columns``, with the character count, if there is one, brought up to date."""
    return rows.select(*[F.length(F.col("text")).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def _stage(f: Callable) -> Callable:
    """On one machine a session without a named folder gets one."""
    return wraps(f)(lambda spark, docs, sf_dir: f(ready(spark), docs, sf_dir))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base measures or lose too much text."""
    return _with_text(line_quality.clean_documents(docs), docs.columns)


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; the model learns from the labelled rows of the raw table."""
    at = sf_dir.rstrip("/")
    model = gam.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    copy, score = (f"__{name}_{'_'.join(docs.columns)}" for name in ("text", "score"))  # longer than any column's name
    scored = gam.score(docs.withColumn(copy, F.col("text")), model, keep=docs.columns, text=copy, out=score)
    return scored.where(F.col(score) >= gam.THRESHOLD).select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash over five-word shingles, similarity 0.8 or more."""
    return simhash_sets.one_per_group(docs).select(*docs.columns)


@_stage
def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words and windows of 400 bytes that also start elsewhere are cut out of every text."""
    with scratch() as s:
        rows = suffix_dedup.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"], as_text=True, prefix="__", words=suffix_dedup.WORDS, cut_words=True)
        return s.keep(stage(_with_text(rows.withColumnRenamed("__kept", "text").select(*docs.columns), docs.columns)))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in sequences of at most 2048 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_spans),
    ("best_fit_packing", packing),
]

#: No SQL for the classifier, the fingerprints or the packing; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, f in STAGES[:-1]:
        with scratch() as s:
            done = s.keep(stage(f(spark, docs, sf_dir)))
        drop(docs)
        docs = done
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(docs)
    return out
