"""How the driver tables stand in for the domain relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Text cues that stand in for categories (fixed values): label -> substring.
CUES = {"Adjacency": "tion", "Depth": "ent", "Laterality": "ing", "Position": "que", "Extent": "ung"}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """One row a question: model (source), pos (doc_id), question_id, and three judges' nullable verdicts."""
    d = documents(spark, sf).select("doc_id", "source", "n_chars")
    x = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(x, "doc_id", "left").select(
        F.col("source").alias("model"), F.col("doc_id").alias("pos"), F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("question_id"),
        (F.col("quality") == 1).alias("v1"), (F.col("toxic") == 0).alias("v2"), (F.col("n_chars") >= 1000).alias("v3"),
    )


def votes_long(spark: SparkSession, sf: str) -> DataFrame:
    v = labelled(spark, sf)
    return v.unpivot(["model", "pos", "question_id"], ["v1", "v2", "v3"], "judge", "is_correct")


#: The same relation in SQL.
LABELLED = """(SELECT source AS model, doc_id AS pos, 'q' || CAST(doc_id % 50 AS VARCHAR) AS question_id,
 quality = 1 AS v1, toxic = 0 AS v2, n_chars >= 1000 AS v3 FROM documents LEFT JOIN labels USING (doc_id))"""
SCORED = f"""(SELECT *, floor((CASE WHEN v1 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN v2 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN v3 THEN 1.0::DOUBLE ELSE 0 END) / 3.0::DOUBLE * 100.0::DOUBLE) / 100.0::DOUBLE AS score FROM {LABELLED})"""
VOTES = f"""(SELECT model, pos, question_id, 'v1' AS judge, v1 AS is_correct FROM {LABELLED} UNION ALL SELECT model, pos, question_id, 'v2', v2 FROM {LABELLED} UNION ALL SELECT model, pos, question_id, 'v3', v3 FROM {LABELLED})"""


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.curate import conversation_pairs as pairs

    return pairs(table(spark, sf, "conversations"))


PAIRS = """(SELECT u.conv_id AS case_id, u.turn AS idx, u.text AS question, a.text AS answer
 FROM conversations u JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn > u.turn
 WHERE u.role = 'user' QUALIFY row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY a.turn) = 1)"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """(question key pos, category array) from the cues; some questions have none."""
    d = documents(spark, sf)
    found = F.filter(F.array(*(F.when(F.col("text").contains(c), F.lit(k)) for k, c in CUES.items())), lambda x: x.isNotNull())
    return d.select(F.col("doc_id").alias("question_id"), found.alias("category"))


CATEGORIES = "(" + " UNION ALL ".join(f"SELECT doc_id AS question_id, '{k}' AS category FROM documents WHERE contains(text, '{c}')" for k, c in CUES.items()) + ")"
