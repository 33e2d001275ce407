"""Sinks: JSON, ordered JSON lines, wide matrices, ragged summaries and tensor files."""

from __future__ import annotations

import io
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, parts: int | None = None) -> None:
    """JSON lines; with ``order`` they are range-sorted, so that the files in name order hold the rows in order."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(parts) if parts else out).write.mode("overwrite").json(path)


def qa_map_json(pairs: DataFrame) -> DataFrame:
    """One JSON object a case: ``(case_id, value)`` with its pairs in index order, to be written as text."""
    each = pairs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("idx", "question", "answer"))).alias("p"))
    body = F.transform("p", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))
    return each.select("case_id", F.to_json(F.create_map("case_id", F.struct(body.alias("qa_pairs")))).alias("value"))


def cell(score: str | Column) -> Column:
    """A score with two decimals; empty for null."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.2f", c))


def matrix_wide(scores: DataFrame, models: list[str], key: str = "question_id") -> DataFrame:
    """One row a question and one text cell a model, models in the given order (an explicit list saves a job)."""
    wide = scores.groupBy(key).pivot("model", models).agg(F.first("score"))
    return wide.select(key, *[cell(F.col(f"`{m}`")).alias(m) for m in models])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the sorted union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def stats_json(rows: DataFrame) -> DataFrame:
    """``value``: one JSON object a row, to be written as text; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def item_rows(df: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """Per item question, answer and prediction, with the scores named."""
    return df.select("question", "answer", "prediction", *(scores or []))


def write_items(df: DataFrame, path: str, scores: list[str] | None = None) -> None:
    write_jsonl(item_rows(df, scores), path)


def write_boxed(rows: DataFrame, path: str, box: Callable[[Column], Column], per_file: int = 10_000) -> None:
    """JSON files of about ``per_file`` rows, so that none grows with the input: ``box`` makes a file's value of its list of rows.

    Rows are dealt by a digest of all columns, so that a lost file comes back the same; equal rows lie in one file.
    """
    files = max(1, -(-rows.count() // per_file))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    lists = rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    lists.select("part", F.to_json(box(F.col("rows"))).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_qa(pairs: DataFrame, path: str, as_list: bool = False, cases_per_file: int = 10_000) -> None:
    """Cases with their pairs in index order: maps from case to pairs, or lists of cases."""
    each = pairs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("idx", "question", "answer"))).alias("p"))
    body = F.transform("p", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))
    cases = each.select(F.col("case_id").cast("string").alias("case_id"), body.alias("qa_pairs"))
    as_map = lambda rows: F.map_from_entries(F.transform(rows, lambda r: F.struct(r["case_id"], F.struct(r["qa_pairs"].alias("qa_pairs")))))
    write_boxed(cases, path, (lambda rows: rows) if as_list else as_map, cases_per_file)


def write_reports_csv(reports: DataFrame, path: str) -> None:
    """Report rows as CSV that ``read_reports_csv`` reads back: quotes doubled, blanks and line breaks kept."""
    out = reports.select("file_name", "findings_en", "impressions_en").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    out.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_tensors(volumes: DataFrame, folder: str, kind: str = "npy") -> DataFrame:
    """Write each volume's data to ``folder`` (a mounted shared path) and return ``(case_id, path)``.

    A file is written under a temporary name and renamed, so a repeated task leaves whole files.
    """

    def work(frames):
        import pandas as pd

        for f in frames:
            done = []
            for case, shape, data in zip(f["case_id"], f["shape"], f["data"], strict=True):
                a = np.asarray(data, np.float32).reshape(tuple(shape))
                buf = io.BytesIO()
                np.savez_compressed(buf, arr=a) if kind == "npz" else np.save(buf, a)
                at = os.path.join(folder, f"{case.removesuffix('.nii.gz')}.{kind}")
                tmp = f"{at}.{os.getpid()}.tmp"
                with open(tmp, "wb") as out:
                    out.write(buf.getvalue())
                os.replace(tmp, at)
                done.append((case, at))
            yield pd.DataFrame(done, columns=["case_id", "path"])

    return volumes.select("case_id", "shape", "data").mapInPandas(work, "case_id string, path string")
