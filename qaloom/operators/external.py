"""External models behind one protocol: generation, judging, classification, prediction and expert calls, with retries.

A backend is any picklable callable from a prompt to a response text.  It is called in Arrow batches on the executors;
``EchoBackend`` and ``TableBackend`` are deterministic stand-ins.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import parse_list

Backend = Callable[[str], str]


class RateLimited(Exception):
    """An error that is worth another try."""


@dataclass
class EchoBackend:
    """Returns a fixed text, whatever the prompt."""

    answer: str = "[]"

    def __call__(self, prompt: str) -> str:
        return self.answer


@dataclass
class TableBackend:
    """Returns the answer of the first key that the prompt contains."""

    table: dict[str, str]
    default: str = ""

    def __call__(self, prompt: str) -> str:
        return next((v for k, v in self.table.items() if k in prompt), self.default)


@dataclass
class Retry:
    """Up to ``tries`` calls; waits base * 2^k plus a quarter of jitter, ``cap`` seconds at most; rate limits only."""

    tries: int = 8
    base: float = 2.0
    cap: float = 120.0
    jitter: Callable[[float], float] = field(default=lambda b: random.uniform(0, b / 4))
    sleep: Callable[[float], None] = time.sleep

    def call(self, backend: Backend, prompt: str) -> str:
        wait = self.base
        for k in range(self.tries):
            try:
                return backend(prompt)
            except RateLimited:
                if k == self.tries - 1:
                    raise
                self.sleep(min(self.cap, wait + self.jitter(wait)))
                wait *= 2
        raise AssertionError("unreachable")


def ask(rows: DataFrame, prompt: str, backend: Backend, retry: Retry | None = None, out: str = "response") -> DataFrame:
    """``rows`` plus the response text and an ``error`` text (null on success); an error never fails the job."""
    retry = retry or Retry()
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(frames):
        for f in frames:
            got, errors = [], []
            for p in f[prompt]:
                try:
                    got.append(retry.call(backend, p))
                    errors.append(None)
                except Exception as e:
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield f.assign(**{out: pd.Series(got, dtype=object, index=f.index), "error": pd.Series(errors, dtype=object, index=f.index)})

    return rows.mapInPandas(run, schema)


def generate_pairs(reports: DataFrame, backend: Backend, template: str = "{findings}\n{impressions}", retry: Retry | None = None) -> DataFrame:
    """Raw QA rows of each report; unreadable output becomes one pair that holds an error and the raw text."""
    none = "(none provided)"
    text = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(none))
    before, rest = template.split("{findings}")
    between, after = rest.split("{impressions}")
    asked = ask(reports.withColumn("prompt", F.concat(F.lit(before), text("findings_en"), F.lit(between), text("impressions_en"), F.lit(after))), "prompt", backend, retry)
    pairs = parse_list("response", schemas.PAIR)
    bad = F.array(F.struct(F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), F.coalesce("error", F.lit("unreadable")).alias("error"), F.col("response").alias("raw_output")))
    return asked.select(F.col("file_name").alias("case_id"), F.posexplode(F.coalesce(pairs, bad)).alias("idx", "p")).select("case_id", "idx", "p.*")


def label_batches(batches: DataFrame, backend: Backend, attempts: int = 3, retry: Retry | None = None) -> DataFrame:
    """One row an item of each batch (``case_id, batch, prompt, n``): labels, or nulls with PARSE_ERROR after ``attempts`` unreadable answers."""
    retry = retry or Retry()
    schema = "case_id string, batch long, results array<struct<is_spatial:boolean,is_relevant:boolean,reasoning:string>>"

    def read(text: str) -> list | None:
        at, end = text.find("["), text.rfind("]")
        try:
            got = json.loads(text[at : end + 1]) if 0 <= at < end else None
        except ValueError:
            return None
        return got if isinstance(got, list) else None

    def run(frames):
        for f in frames:
            out = []
            for case, batch, prompt, n in zip(f["case_id"], f["batch"], f["prompt"], f["n"], strict=True):
                text, got = "", None
                for _ in range(attempts):
                    try:
                        text = retry.call(backend, prompt) or ""
                    except Exception as e:
                        text = f"{type(e).__name__}: {e}"
                        continue
                    got = read(text)
                    if got is not None:
                        break
                if got is None:
                    rows = [{"is_spatial": None, "is_relevant": None, "reasoning": f"PARSE_ERROR: {text}"}] * int(n)
                else:
                    rows = [{k: g.get(k) for k in ("is_spatial", "is_relevant", "reasoning")} if isinstance(g, dict) else {} for g in got]
                out.append((case, batch, rows))
            yield pd.DataFrame(out, columns=["case_id", "batch", "results"])

    return batches.select("case_id", "batch", "prompt", "n").mapInPandas(run, schema)


def judge_answers(items: DataFrame, backend: Backend, size: int = 5, retry: Retry | None = None) -> DataFrame:
    """Verdicts of (case_id, question, answer, prediction) items in global batches of ``size`` by ``pos``.

    A readable answer is zipped with its batch (a short one loses the rest); an error or unreadable answer gives null rows.
    """
    line = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nPrediction: "), F.coalesce("prediction", F.lit("")))
    rows = items.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"), F.count("*").alias("n"))
    prompt = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    answered = ask(grouped.select("batch", "n", prompt.alias("prompt")), "prompt", backend, retry)
    verdict = T.StructType([T.StructField("is_correct", T.BooleanType()), T.StructField("reasoning", T.StringType())])
    empty = F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.struct(F.lit(None).cast("boolean").alias("is_correct"), F.coalesce("error", "response").alias("reasoning")))
    flat = answered.select("batch", F.posexplode(F.coalesce(parse_list("response", verdict), empty)).alias("i", "r"))
    placed = rows.withColumn("i", (F.col("pos") % size).cast("int"))
    return placed.join(flat, ["batch", "i"]).select("pos", "case_id", "question", "answer", "prediction", "r.is_correct", "r.reasoning")


def classify(pairs: DataFrame, backend: Backend, retry: Retry | None = None) -> DataFrame:
    """Categories of pairs that have none yet, with a ``status`` (done or failed) so that a failure can be tried again."""
    from ..functions.text import canonical_categories, parse_categories

    prompt = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    asked = ask(pairs.where("category is null").drop("category").withColumn("prompt", prompt), "prompt", backend, retry)
    found = canonical_categories(parse_categories(F.coalesce("response", F.lit(""))))
    out = asked.withColumn("category", found).withColumn("status", F.when(F.size("category") > 0, "done").otherwise("failed"))
    return out.drop("prompt", "response", "error")


def predict(rows: DataFrame, backend: Backend, retry: Retry | None = None, empties: int = 3) -> DataFrame:
    """``prediction`` for each (case_id, question); an empty output is asked for again up to ``empties`` times."""

    def again(prompt: str) -> str:
        for _ in range(empties):
            text = (backend(prompt) or "").strip()
            if text:
                return text
        return ""

    prompt = F.concat_ws("\n", F.coalesce("image_path", F.lit("")), F.coalesce(F.nullif("question", F.lit("")), F.lit("Describe the findings.")))
    return ask(rows.withColumn("prompt", prompt), "prompt", again, retry, "prediction").drop("prompt", "error")


def expert_once(rows: DataFrame, backend: Backend, known: DataFrame | None = None, retry: Retry | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their case's expert ``text_output``, all known expert rows): each case is asked once, known ones not at all."""
    cases = rows.select("case_id").distinct()
    fresh = cases.join(known.select("case_id"), "case_id", "left_anti") if known is not None else cases
    got = ask(fresh, "case_id", backend, retry, "text_output").select("case_id", "text_output")
    everything = known.select("case_id", "text_output").unionByName(got) if known is not None else got
    return rows.join(everything, "case_id", "left"), everything


def stops_at(text: str, keywords: list[str]) -> str:
    """A generated text up to and with the first keyword."""
    ends = [text.find(k) + len(k) for k in keywords if k in text]
    return text[: min(ends)] if ends else text
