"""Text-similarity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..operators import metrics
from ..session import table
from . import _data as D
from .registry import query

_E = "CAST(embedding AS DOUBLE[])"


@query("embedding_cosine_pairs", f"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(cosine("embedding", "other"), 6).alias("cos"))


@query("embedding_cosine_by_label", """SELECT a.label, count(*) AS count, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS sbert_cosine
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def embedding_cosine_by_label(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = metrics.summarize(metrics.embedding_cosine(e.join(b, "vec_id"), "embedding", "other"), ["label"], ["sbert_cosine"])
    return out.withColumn("sbert_cosine", F.round("sbert_cosine", 6))


def _pairs(spark, sf):
    p = D.conversation_pairs(spark, sf)
    return metrics.usable_pairs(p.select("case_id", "idx", F.col("answer").alias("prediction"), F.col("question").alias("reference")))


_TOK = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
 '([\{{-\~\[-\x60 -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '')"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_BASE = f"(SELECT case_id, idx, {_STRIP.format('answer')} AS p, {_STRIP.format('question')} AS r FROM {D.PAIRS})"
_BLEU = f"""(WITH t AS (SELECT case_id, idx, {_TOK.format('p')} AS p, {_TOK.format('r')} AS r FROM {_BASE} WHERE r <> ''),
 g AS (SELECT case_id, idx, n, s, array_to_string(w[i:i+n-1], chr(1)) AS gram, count(*) AS c FROM (SELECT case_id, idx, n, s, w, unnest(range(1, len(w) - n + 2)) AS i FROM
   (SELECT case_id, idx, unnest([1, 2, 3, 4]) AS n, s, w FROM (SELECT case_id, idx, 'p' AS s, p AS w FROM t UNION ALL SELECT case_id, idx, 'r', r FROM t))) GROUP BY ALL),
 m AS (SELECT a.n, sum(least(a.c, b.c)) AS matched FROM g a JOIN g b USING (case_id, idx, n, gram) WHERE a.s = 'p' AND b.s = 'r' GROUP BY a.n),
 k AS (SELECT n, sum(greatest(len(p) - n + 1, 0)) AS total, sum(len(p)) AS sys_len, sum(len(r)) AS ref_len FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) GROUP BY n)
 SELECT n::INT AS n, coalesce(matched, 0)::BIGINT AS matched, total::BIGINT AS total, sys_len::BIGINT AS sys_len, ref_len::BIGINT AS ref_len FROM k LEFT JOIN m USING (n))"""


@query("bleu_ngram_stats", f"SELECT * FROM {_BLEU}")
def bleu_ngram_stats(spark, sf):
    return metrics.bleu_stats(_pairs(spark, sf), [])


@query("corpus_bleu", f"""SELECT round(CASE WHEN max(sys_len) >= max(ref_len) THEN 1.0 ELSE exp(1 - max(ref_len)::DOUBLE / max(sys_len)) END * exp(sum(ln(100.0::DOUBLE * CASE WHEN matched = 0 THEN 1.0 / pow(2, z) ELSE matched END / total)) / 4), 6) AS bleu, max(sys_len) AS sys_len, max(ref_len) AS ref_len
 FROM (SELECT *, count(*) FILTER (matched = 0) OVER (ORDER BY n) AS z FROM {_BLEU})""")
def corpus_bleu(spark, sf):
    return metrics.corpus_bleu(metrics.bleu_stats(_pairs(spark, sf), []), []).withColumn("bleu", F.round("bleu", 6))


_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _rouge_sql(n: int) -> str:
    return f"""WITH t AS (SELECT case_id, idx, {_WORDS.format('p')} AS p, {_WORDS.format('r')} AS r FROM {_BASE} WHERE r <> ''),
 g AS (SELECT case_id, idx, s, array_to_string(w[i:i+{n - 1}], ' ') AS gram, count(*) AS c FROM (SELECT case_id, idx, s, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT case_id, idx, 'p' AS s, p AS w FROM t UNION ALL SELECT case_id, idx, 'r', r FROM t)) GROUP BY ALL),
 m AS (SELECT a.case_id, a.idx, sum(least(a.c, b.c)) AS matched FROM g a JOIN g b USING (case_id, idx, gram) WHERE a.s = 'p' AND b.s = 'r' GROUP BY 1, 2)
 SELECT case_id, idx, round(CASE WHEN coalesce(matched, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * matched::DOUBLE / (len(p) - {n} + 1 + len(r) - {n} + 1) END, 6) AS rouge{n}_f FROM t LEFT JOIN m USING (case_id, idx)"""


@query("rouge1_f", _rouge_sql(1))
def rouge1_f(spark, sf):
    return metrics.rouge(_pairs(spark, sf), stemmed=False).select("case_id", "idx", F.round("rouge1_f", 6).alias("rouge1_f"))


@query("rouge2_f", _rouge_sql(2))
def rouge2_f(spark, sf):
    return metrics.rouge(_pairs(spark, sf), stemmed=False).select("case_id", "idx", F.round("rouge2_f", 6).alias("rouge2_f"))


# the longest common subsequence row by row: row i of the table is the running maximum of what row i - 1 and a match give
_LCS = f"""WITH RECURSIVE t AS (SELECT case_id, idx, {_WORDS.format('p')} AS p, {_WORDS.format('r')} AS r FROM {_BASE} WHERE r <> ''),
 across AS (SELECT case_id, idx, unnest(range(1, len(p) + 1)) AS j, unnest(p) AS w FROM t),
 down AS (SELECT case_id, idx, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS x FROM t),
 cells AS (SELECT case_id, idx, 0::BIGINT AS i, j, w, 0::BIGINT AS v FROM across
  UNION ALL SELECT case_id, idx, i, j, w, max(u) OVER (PARTITION BY case_id, idx ORDER BY j) AS v FROM
   (SELECT c.case_id, c.idx, d.i, c.j, c.w, greatest(c.v, lag(c.v, 1, 0::BIGINT) OVER (PARTITION BY c.case_id, c.idx ORDER BY c.j) + CASE WHEN c.w = d.x THEN 1 ELSE 0 END) AS u
    FROM cells c JOIN down d ON d.case_id = c.case_id AND d.idx = c.idx AND d.i = c.i + 1)),
 l AS (SELECT case_id, idx, max(v) AS l FROM cells GROUP BY 1, 2)
 SELECT case_id, idx, round(CASE WHEN coalesce(l, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * l::DOUBLE / (len(p) + len(r)) END, 6) AS rougeL_f FROM t LEFT JOIN l USING (case_id, idx)"""


@query("rougeL_f", _LCS)
def rouge_l(spark, sf):
    return metrics.rouge(_pairs(spark, sf), stemmed=False).select("case_id", "idx", F.round("rougeL_f", 6).alias("rougeL_f"))


@query("rouge_stemmed")
def rouge_stemmed(spark, sf):
    return metrics.rouge(_pairs(spark, sf)).select("case_id", "idx", "rouge1_f", "rouge2_f", "rougeL_f")


@query("meteor")
def meteor(spark, sf):
    return _pairs(spark, sf).select("case_id", "idx", metrics.meteor("prediction", "reference").alias("meteor"))


@query("metrics_summary")
def metrics_summary(spark, sf):
    scored = metrics.rouge(_pairs(spark, sf)).withColumn("meteor", metrics.meteor("prediction", "reference")).withColumn("model", F.concat(F.lit("m"), (F.col("case_id") % 3).cast("string")))
    return metrics.summarize(scored, ["model"], ["rouge1_f", "rouge2_f", "rougeL_f", "meteor"])


#: Words with the same first three letters are one class, where both have four letters at least.
_CLASS = "CASE WHEN length(w) > 3 THEN substr(w, 1, 3) END"


def _staged(source: str, key: str, name: str) -> str:
    """SQL of one stage over free words ``source``: (case_id, idx, i, j) pairs of ranked occurrences from the end, and the rest."""
    ranked = f"(SELECT *, {key} AS k, row_number() OVER (PARTITION BY case_id, idx, side, {key} ORDER BY pos DESC) AS n FROM {source} WHERE {key} IS NOT NULL)"
    return f"""{name} AS (SELECT a.case_id, a.idx, a.pos AS i, b.pos AS j FROM {ranked} a JOIN {ranked} b ON a.case_id = b.case_id AND a.idx = b.idx AND a.k = b.k AND a.n = b.n AND a.side = 'p' AND b.side = 'r'),
 {name}_free AS (SELECT * FROM {source} s WHERE NOT EXISTS (FROM {name} m WHERE m.case_id = s.case_id AND m.idx = s.idx AND s.pos = CASE s.side WHEN 'p' THEN m.i ELSE m.j END))"""


@query("meteor_aligned", rf"""WITH t AS (SELECT case_id, idx, {{pair_p}} AS p, {{pair_r}} AS r FROM {D.PAIRS}), sides AS (SELECT case_id, idx, 'p' AS side, list_filter(regexp_split_to_array(lower(p), '\s+'), lambda x: x <> '') AS ws FROM t UNION ALL SELECT case_id, idx, 'r', list_filter(regexp_split_to_array(lower(r), '\s+'), lambda x: x <> '') FROM t),
 words AS (SELECT case_id, idx, side, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM sides),
 {_staged("words", "w", "one")}, {_staged("one_free", _CLASS, "two")}, pairs AS (FROM one UNION ALL FROM two),
 steps AS (SELECT case_id, idx, CASE WHEN i = lag(i) OVER q + 1 AND j = lag(j) OVER q + 1 THEN 0 ELSE 1 END AS new FROM pairs WINDOW q AS (PARTITION BY case_id, idx ORDER BY i)),
 m AS (SELECT case_id, idx, count(*) AS matched, sum(new) AS chunks FROM steps GROUP BY ALL),
 n AS (SELECT case_id, idx, max(len(ws)) FILTER (side = 'p') AS p, max(len(ws)) FILTER (side = 'r') AS r FROM sides GROUP BY ALL)
 SELECT case_id, idx, coalesce(matched, 0) AS matched, coalesce(chunks, 0)::BIGINT AS chunks, round(coalesce((matched / p) * (matched / r) / (0.9 * (matched / p) + (1 - 0.9) * (matched / r)) * (1 - 0.5 * pow(chunks / matched, 3)), 0) + 1e-9, 6) AS meteor FROM n LEFT JOIN m USING (case_id, idx)""".replace("{pair_p}", "answer").replace("{pair_r}", "question"))
def meteor_aligned(spark, sf):
    pairs = D.conversation_pairs(spark, sf).select("case_id", "idx", F.col("answer").alias("prediction"), F.col("question").alias("reference"))
    words = pairs.select(F.explode(F.split(F.lower(F.concat_ws(" ", "prediction", "reference")), r"\s+")).alias("word")).distinct()
    classes = words.where(F.length("word") > 3).select("word", F.substring("word", 1, 3).alias("class"))
    out = metrics.meteor_aligned(pairs, ["case_id", "idx"], synonyms=classes, stemmed=False)
    return out.withColumn("meteor", F.round(F.col("meteor") + 1e-9, 6))  # not at a tie
