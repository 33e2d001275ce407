"""Text-similarity metrics: embedding cosine, corpus BLEU, ROUGE and METEOR.

Overlaps of a row's two texts are computed inside the row by Arrow batches, so n-grams are never exploded or shuffled;
what is aggregated are a few counts or scores.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import cosine
from ..functions.porter import stem
from ..functions.text import normalize

MAX_ORDER = 4
OVERLAPS = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("matched", "predicted", "referred"))]))
#: METEOR's recall weight, fragmentation exponent and weight (fixed values).
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: The replacements of the mteval-13a tokenisation, in order (fixed values).
RULES_13A = (
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
)
SPLITS_13A = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "), (r"([^0-9])([\.,])", r"$1 $2 "), (r"([\.,])([^0-9])", r" $1 $2"), (r"([0-9])(-)", r"$1 $2 "))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens_13a(text: str | Column) -> Column:
    """Tokens of the standard BLEU tokenisation."""
    t = _c(text)
    for a, b in RULES_13A:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, to in SPLITS_13A:
        t = F.regexp_replace(t, pattern, to)
    return F.filter(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+"), lambda x: x != "")


def rouge_tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def usable_pairs(rows: DataFrame, prediction: str = "prediction", reference: str = "reference", skip_empty: bool = False, lower: bool = False) -> DataFrame:
    """Normalised pairs with a reference, and with a prediction too if ``skip_empty``."""
    out = rows.withColumns({prediction: normalize(prediction, lower), reference: normalize(reference, lower)}).where(F.col(reference) != "")
    return out.where(F.col(prediction) != "") if skip_empty else out


def _grams(tokens, n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


@F.pandas_udf(OVERLAPS)
def _overlaps(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(prediction, reference, strict=True):
        p, r = [] if p is None else list(p), [] if r is None else list(r)
        row = []
        for n in range(1, MAX_ORDER + 1):
            a, b = _grams(p, n), _grams(r, n)
            row.append({"n": n, "matched": sum((a & b).values()), "predicted": max(0, len(p) - n + 1), "referred": max(0, len(r) - n + 1)})
        out.append(row)
    return pd.Series(out)


def ngram_overlaps(prediction: str | Column, reference: str | Column) -> Column:
    """For n = 1..4: clipped matches and totals of two token arrays."""
    return _overlaps(_c(prediction), _c(reference))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel over the first sequence."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & places.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)], dtype="int64")


def lcs(a: str | Column, b: str | Column) -> Column:
    return _lcs(_c(a), _c(b))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [stem(x) if len(x) > 3 else x for x in t] for t in tokens])


def stems(tokens: str | Column) -> Column:
    """Porter stems of tokens longer than three letters."""
    return _stems(_c(tokens))


def f_measure(matched: Column, predicted: Column, referred: Column) -> Column:
    """Harmonic mean of precision and recall; 0 if nothing matches."""
    return F.when(matched <= 0, F.lit(0.0)).otherwise(2.0 * matched / (predicted + referred))


def rouge(rows: DataFrame, prediction: str = "prediction", reference: str = "reference", stemmed: bool = True) -> DataFrame:
    """``rows`` plus ``rouge1_f, rouge2_f, rougeL_f``."""
    p, r = rouge_tokens(prediction), rouge_tokens(reference)
    if stemmed:
        p, r = stems(p), stems(r)
    out = rows.withColumns({"__p": p, "__r": r}).withColumns({"__o": ngram_overlaps("__p", "__r"), "__l": lcs("__r", "__p")})
    one, two = F.get("__o", 0), F.get("__o", 1)
    score = lambda o: f_measure(o["matched"], o["predicted"], o["referred"])
    out = out.withColumns({"rouge1_f": score(one), "rouge2_f": score(two), "rougeL_f": f_measure(F.col("__l"), F.size("__p"), F.size("__r"))})
    return out.drop("__p", "__r", "__o", "__l")


def bleu_stats(rows: DataFrame, keys: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Per key and n: summed matches and totals, with the summed lengths of both sides."""
    t = rows.select(*keys, tokens_13a(prediction).alias("p"), tokens_13a(reference).alias("r"))
    t = t.select(*keys, F.size("p").alias("pl"), F.size("r").alias("rl"), F.explode(ngram_overlaps("p", "r")).alias("o"))
    return t.groupBy(*keys, F.col("o.n").alias("n")).agg(F.sum("o.matched").alias("matched"), F.sum("o.predicted").alias("total"), F.sum("pl").cast("long").alias("sys_len"), F.sum("rl").cast("long").alias("ref_len"))


def corpus_bleu(stats: DataFrame, keys: list[str]) -> DataFrame:
    """BLEU (0..100) from summed counts: exponential smoothing of zero matches, brevity penalty; 0 if an order has no n-grams."""
    rows = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "matched", "total"))).alias("s"), F.max("sys_len").alias("sys_len"), F.max("ref_len").alias("ref_len"))
    step = lambda acc, x: F.struct(
        F.when(x["matched"] == 0, acc["smooth"] * 2.0).otherwise(acc["smooth"]).alias("smooth"),
        (acc["logs"] + F.when(x["total"] == 0, F.lit(-1e10)).when(x["matched"] == 0, F.log(F.lit(100.0) / (acc["smooth"] * 2.0 * x["total"]))).otherwise(F.log(F.lit(100.0) * x["matched"] / x["total"]))).alias("logs"),
    )
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("logs"))
    logs = F.aggregate("s", start, step, lambda a: a["logs"])
    brevity = F.when(F.col("sys_len") >= F.col("ref_len"), F.lit(1.0)).when(F.col("sys_len") == 0, F.lit(0.0)).otherwise(F.exp(1.0 - F.col("ref_len") / F.col("sys_len")))
    return rows.select(*keys, (brevity * F.exp(logs / float(MAX_ORDER))).alias("bleu"), "sys_len", "ref_len")


def _meteor_of(matched: Column, chunks: Column, predicted: Column, referred: Column) -> Column:
    p, r = matched / predicted, matched / referred
    mean = p * r / (F.lit(ALPHA) * p + F.lit(1 - ALPHA) * r)
    return F.when(F.coalesce(matched, F.lit(0)) == 0, F.lit(0.0)).otherwise(mean * (1 - F.lit(GAMMA) * F.pow(chunks / matched, F.lit(BETA))))


def meteor_alignment(rows: DataFrame, keys: list[str], prediction: str = "prediction", reference: str = "reference", synonyms: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """``keys`` and ``side`` (p or r), ``pos, word, other``: every word of both texts with the place that it is aligned to, or null.

    Words stand between white space, lower-cased.  Stages go one after another over the words that are still free: equal words, then
    words with equal stems, then words of one class in ``synonyms`` (``word, class``; a word has one class).  Inside a stage the last
    free occurrence on one side meets the last one on the other, then the last but one, and so on: what a search from both texts' ends
    gives.  ``keys`` name a row.  The words of a pair are dealt once by its keys; all stages are windows over them.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), r"\s+"), lambda x: x != "")
    sides = F.array(F.struct(F.lit("p").alias("side"), words(prediction).alias("w")), F.struct(F.lit("r").alias("side"), words(reference).alias("w")))
    flat = rows.select(*keys, F.inline(sides)).select(*keys, "side", F.posexplode("w").alias("pos", "word"))
    stages = {"__k0": F.col("word")}
    if stemmed:
        flat = flat.withColumn("__stem", _word_stem("word"))
        stages["__k1"] = F.col("__stem")
    if synonyms is not None:
        flat = flat.join(synonyms.select("word", F.col("class").alias("__class")), "word", "left")
        stages["__k2"] = F.col("__class")
    out = flat.repartition(*keys).withColumn("other", F.lit(None).cast("int"))
    for name, value in stages.items():
        free = F.col("other").isNull() & value.isNotNull()
        out = out.withColumn(name, F.when(free, value))
        rank = F.row_number().over(W.partitionBy(*keys, name, "side").orderBy(F.desc("pos")))
        same = W.partitionBy(*keys, name, "__n")  # one row a side at most
        theirs = lambda side: F.max(F.when(F.col("side") == side, F.col("pos"))).over(same)
        out = out.withColumn("__n", rank).withColumn("__o", F.when(F.col("side") == "p", theirs("r")).otherwise(theirs("p")))
        out = out.withColumn("other", F.when(F.col(name).isNotNull(), F.col("__o")).otherwise(F.col("other"))).drop("__n", "__o")
    return out.select(*keys, "side", "pos", "word", "other")


def meteor_aligned(rows: DataFrame, keys: list[str], prediction: str = "prediction", reference: str = "reference", synonyms: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """``keys, matched, chunks, meteor`` from the alignment: chunks are runs of matches that follow each other on both sides."""
    words = meteor_alignment(rows, keys, prediction, reference, synonyms, stemmed)
    matched = (F.col("side") == "p") & F.col("other").isNotNull()
    run = W.partitionBy(*keys, "__m").orderBy("pos")
    goes_on = F.coalesce((F.col("pos") == F.lag("pos").over(run) + 1) & (F.col("other") == F.lag("other").over(run) + 1), F.lit(False))
    counted = words.withColumn("__m", matched).withColumn("__new", F.col("__m") & ~goes_on)
    sums = counted.groupBy(*keys).agg(F.count_if("__m").alias("matched"), F.count_if("__new").alias("chunks"), F.count_if(F.col("side") == "p").alias("__p"), F.count_if(F.col("side") == "r").alias("__r"))
    zero = F.lit(0).cast("long")
    scored = rows.select(*keys).join(sums, keys, "left")
    return scored.select(*keys, F.coalesce("matched", zero).alias("matched"), F.coalesce("chunks", zero).alias("chunks"), _meteor_of(F.col("matched"), F.col("chunks"), F.col("__p"), F.col("__r")).alias("meteor"))


@F.pandas_udf(T.StringType())
def _word_stem(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


def meteor_score(prediction: list[str], reference: list[str], classes: dict[str, str] | None = None) -> float:
    """Exact, stem, then synonym matches; in each stage the last free occurrence on one side meets the last on the other."""
    pairs: list[tuple[int, int]] = []
    left, right = set(range(len(prediction))), set(range(len(reference)))
    for key in (lambda w: w, stem, (classes or {}).get):
        at: dict[str, list[int]] = {}
        for j in sorted(right):
            at.setdefault(key(reference[j]), []).append(j)
        at.pop(None, None)
        for i in sorted(left, reverse=True):
            choices = at.get(key(prediction[i]))
            if choices:
                j = choices.pop()
                pairs.append((i, j))
                left.discard(i)
                right.discard(j)
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(prediction), len(pairs) / len(reference)
    mean = p * r / (ALPHA * p + (1 - ALPHA) * r)
    return mean * (1 - GAMMA * (chunks / len(pairs)) ** BETA)


@F.pandas_udf(T.DoubleType())
def _meteor(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    words = lambda t: re.findall(r"\S+", (t or "").lower())
    return pd.Series([meteor_score(words(p), words(r)) for p, r in zip(prediction, reference, strict=True)], dtype="float64")


def meteor(prediction: str | Column, reference: str | Column) -> Column:
    """METEOR over white-space tokens with exact and stem stages, a row at a time; ``meteor_aligned`` takes synonyms too."""
    return _meteor(_c(prediction), _c(reference))


def embedding_cosine(rows: DataFrame, a: str, b: str, out: str = "sbert_cosine") -> DataFrame:
    return rows.withColumn(out, cosine(a, b))


def summarize(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Count and mean of each metric."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), *[F.avg(m).alias(m) for m in metrics])
