"""Length statistics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import stats
from ..session import table
from . import _data as D
from .registry import query

_WC = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
_WORDS = f"(SELECT doc_id, lang, source, {_WC}::BIGINT AS words FROM documents)"


def _words(spark, sf):
    return D.documents(spark, sf).select("doc_id", "lang", "source", word_count("text").alias("words"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


_STATS = "count({0}) AS count, round(avg({0}), 6) AS mean, round(median({0})::DOUBLE, 6) AS median, round(stddev_pop({0}), 6) AS std, min({0}) AS min, max({0}) AS max"


@query("doc_word_counts", f"SELECT doc_id, words FROM {_WORDS}")
def doc_word_counts(spark, sf):
    return _words(spark, sf).select("doc_id", "words")


@query("doc_length_stats", f"SELECT source, {_STATS.format('words')} FROM {_WORDS} GROUP BY source")
def doc_length_stats(spark, sf):
    return _rounded(stats.summary(_words(spark, sf), "words", ["source"]))


@query("doc_length_histogram", f"""WITH b(bin, lo, hi) AS (VALUES ('1-5', 0, 5), ('6-10', 5, 10), ('11-20', 10, 20), ('21-30', 20, 30), ('31-40', 30, 40), ('41-50', 40, 50), ('51-100', 50, 100), ('>100', 100, 1000000000)),
 w AS (SELECT words FROM {_WORDS})
 SELECT bin, count(words) AS n FROM b LEFT JOIN w ON words > lo AND words <= hi GROUP BY bin UNION ALL SELECT '0', count(*) FROM w WHERE words = 0 HAVING count(*) > 0""")
def doc_length_histogram(spark, sf):
    return stats.histogram(spark, _words(spark, sf), "words")


_TURNS = "(SELECT conv_id, count(*) FILTER (role = 'user')::BIGINT AS turns FROM conversations GROUP BY conv_id)"


def _turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))


@query("turns_per_conversation_stats", f"SELECT {_STATS.format('turns')} FROM {_TURNS}")
def turns_per_conversation_stats(spark, sf):
    return _rounded(stats.summary(_turns(spark, sf), "turns"))


@query("turns_per_conversation_distribution", f"SELECT turns, count(*) AS n FROM {_TURNS} GROUP BY turns")
def turns_per_conversation_distribution(spark, sf):
    return stats.distribution(_turns(spark, sf), "turns")


_KDE = f"""(WITH w AS (SELECT lang, words::DOUBLE AS v FROM {_WORDS}), c AS (SELECT lang, v, count(*) AS n FROM w GROUP BY ALL),
 a AS (SELECT lang, stddev_pop(v) AS sd, count(*) AS total, min(v) AS lo, max(v) AS hi FROM w GROUP BY lang),
 g AS (SELECT lang, total, CASE WHEN sd = 0 THEN 0.4 ELSE greatest(0.2, 1.06 * sd * pow(total, -0.2)) END AS h, lo, hi, unnest(range(0, 220)) AS i FROM a),
 x AS (SELECT *, lo + (hi - lo) * i / 219 AS x FROM g)
 SELECT lang, i::INT AS i, x, sum(n * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(total) * any_value(h) * 2.5066282746310002) AS density FROM x JOIN c USING (lang) GROUP BY lang, i, x)"""


@query("length_kde", f"SELECT lang, i, round(x, 6) AS x, round(density, 9) AS density FROM {_KDE}")
def length_kde(spark, sf):
    d = stats.kde(_words(spark, sf), "lang", "words")
    return d.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


_QUART = f"""(WITH q AS (SELECT lang, quantile_cont(words, 0.25) AS q1, quantile_cont(words, 0.5) AS q2, quantile_cont(words, 0.75) AS q3 FROM {_WORDS} GROUP BY lang)
 SELECT lang, q1, q2, q3, min(words) FILTER (words >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(words) FILTER (words <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM q JOIN {_WORDS} USING (lang) GROUP BY lang, q1, q2, q3)"""


@query("length_quartiles", f"SELECT * FROM {_QUART}")
def length_quartiles(spark, sf):
    return stats.quartiles(_words(spark, sf), "lang", "words")


@query("length_violin", f"""SELECT k.lang, k.i, round(density / max(density) OVER (PARTITION BY k.lang), 6) AS width,
 k.i = first_value(k.i) OVER (PARTITION BY k.lang ORDER BY abs(x - q2), k.i) AS at_median FROM {_KDE} k JOIN {_QUART} q ON k.lang = q.lang""")
def length_violin(spark, sf):
    w = _words(spark, sf)
    v = stats.violin(stats.kde(w, "lang", "words"), stats.quartiles(w, "lang", "words"), "lang")
    return v.select("lang", "i", F.round("width", 6).alias("width"), "at_median")


_VALUES = "(SELECT vec_id % 3 AS g, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _values(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 3).alias("g"), F.explode(F.col("embedding").cast("array<double>")).alias("v"))


@query("value_stats", f"SELECT g, count(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM {_VALUES} GROUP BY g")
def value_stats(spark, sf):
    s = stats.summary(_values(spark, sf), "v", ["g"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "min", "max")})


@query("value_quartiles", f"""WITH q AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM {_VALUES} GROUP BY g)
 SELECT g, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM q JOIN {_VALUES} USING (g) GROUP BY g, q1, q2, q3""")
def value_quartiles(spark, sf):
    q = stats.quartiles(_values(spark, sf), "g", "v")
    return q.select("g", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3", "whisker_low", "whisker_high")])
