"""Source divergence audit: how far the term shares of a language's sources lie apart.

Terms are counted by chunk (one row for each term of a chunk, with the counts of its sources) and joined with the terms that
enough documents of the language have.  A kept term then is a sparse vector of counts, one for each source that has it.  Terms
with identical vectors are grouped: a pair of sources is evaluated once for each distinct vector and its value multiplied by the
number of terms that have it.  Vectors are dealt to tasks in shards, and a task holds the pairs of ``TILE`` sums at most; sums of
shards are added up by a shuffle.  For the ranking of single terms the original terms come back to their vectors.

All values are integers: shares are floored to 10^-9, counts and products that could pass 64 bits are computed in decimals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scratch, stage, text_bytes

#: Documents of its language that a kept term must be in.
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP = 50
#: Bytes of texts that are counted together; a longer text is counted alone, in pieces.
CHUNK = 4 << 20
#: Distinct vectors a shard, and sums that a task holds.
SHARD, TILE = 20_000, 1 << 20
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Every byte as a term has it: A-Z lower-cased, other ASCII that is no letter a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n_docs", T.LongType()),
    T.StructField("by", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("n", T.LongType())]))),
])
_BY = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(langs: list[str], sources: list[str], texts: list[bytes]) -> pa.RecordBatch:
    """The counts of some documents: for each language and term the documents and the occurrences by source."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    coded = lists.values.dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if (blank := pc.index(terms, "").as_py()) >= 0:
        doc, code = doc[code != blank], code[code != blank]
    lang_names, lang = np.unique(np.array(langs, object), return_inverse=True)
    source_names, source = np.unique(np.array(sources, object), return_inverse=True)
    size = max(1, len(terms))
    in_doc = np.unique(doc * size + code)  # a term counts once a document
    pair, n_docs = np.unique(lang[in_doc // size] * size + in_doc % size, return_counts=True)
    full, n = np.unique((lang[doc] * size + code) * len(source_names) + source[doc], return_counts=True)
    at = _starts(full // len(source_names))
    names = pa.array(source_names, pa.string()).take(pa.array(full % len(source_names)))
    by = pa.ListArray.from_arrays(pa.array(np.append(at, len(full)), pa.int32()), pa.StructArray.from_arrays([names, pa.array(n, pa.int64())], names=["source", "n"]))
    return pa.RecordBatch.from_arrays([pa.array(lang_names, pa.string()).take(pa.array(pair // size)), terms.take(pa.array(pair % size)), pa.array(n_docs, pa.int64()), by], names=COUNTS.names)


def _long_text(lang: str, source: str, text: bytes, piece: int) -> pa.RecordBatch:
    """The counts of one long document, from pieces that end at blanks of the plain text."""
    seen: dict[bytes, int] = {}
    pos = 0
    while pos < len(text):
        end = pos + piece
        plain = text[pos:end].translate(_PLAIN)
        if end < len(text):
            if (last := plain.rfind(b" ")) >= 0:
                plain, end = plain[:last], pos + last + 1
            else:  # a term that is longer than the piece
                while end < len(text) and (x := text[end : end + 4096].translate(_PLAIN)).find(b" ") < 0:
                    plain, end = plain + x, end + len(x)
                rest = text[end : end + 4096].translate(_PLAIN).split(b" ", 1)[0]
                plain, end = plain + rest, end + len(rest)
        for w in plain.split():
            seen[w] = seen.get(w, 0) + 1
        pos = end
    n = len(seen)
    values = pa.StructArray.from_arrays([pa.array([source] * n, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["source", "n"])
    by = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(np.ones(n, np.int64)), by], names=COUNTS.names)


def _counts(batches, chunk: int):
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            if len(raw) > chunk:
                yield _long_text(lang, source, raw, chunk)
                continue
            for column, v in zip(held, (lang, source, raw.translate(_PLAIN)), strict=True):
                column.append(v)
            size += len(raw)
            if size >= chunk:
                yield _counted(*held)
                held, size = ([], [], []), 0
    if held[0]:
        yield _counted(*held)


def share(n, total, terms):
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) as a column, in decimals."""
    top = (n.cast("decimal(20,0)") + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + terms.cast("decimal(15,0)") * F.lit(PRIOR).cast("decimal(1,0)")
    top, below = (x.cast("decimal(38,0)") for x in (top, below))
    return F.call_function("div", top, below) + F.lit(1).cast("long")


def _shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    if n.size and int(n.max()) + PRIOR >= (1 << 63) // SCALE:
        return ((n.astype(object) + PRIOR) * SCALE // below.astype(object)).astype(np.int64) + 1
    return (n + PRIOR) * SCALE // below + 1


SUMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("item", T.StringType()), T.StructField("value", T.LongType())])


def _pair_sums(key, vectors: pa.Table, sources: pa.Table, tile: int) -> pa.Table:
    """Of one shard of a language's vectors the summed differences of the pairs ``(source, item)`` of one tile."""
    lang, number = key[0].as_py(), key[2].as_py()
    sources = sources.sort_by("source")
    names, below = sources.column("source").combine_chunks(), sources.column("below").to_numpy()
    k = len(names)
    rows = max(1, tile // k)
    mine = np.arange(number * rows, min(k, (number + 1) * rows))
    if not len(mine):
        return pa.table([pa.array([], f.type) for f in (pa.field("", pa.string()),) * 3] + [pa.array([], pa.int64())], names=SUMS.names)
    by, times = vectors.column("by").combine_chunks(), vectors.column("times").to_numpy()
    offsets = by.offsets.to_numpy()
    flat = by.flatten()
    place = pc.index_in(flat.field("source"), names).to_numpy()
    n = flat.field("n").to_numpy()
    sums = np.zeros((len(mine), k), np.int64)
    step = max(1, (1 << 20) // k)
    row = np.repeat(np.arange(len(times)), np.diff(offsets))
    for a in range(0, len(times), step):
        z = min(len(times), a + step)
        counts = np.zeros((z - a, k), np.int64)
        some = slice(offsets[a] - offsets[0], offsets[z] - offsets[0])
        counts[row[some] - a, place[some]] = n[some]
        p, m = _shares(counts, below), times[a:z, None]
        for i, s in enumerate(mine):
            sums[i] += (np.abs(p - p[:, s : s + 1]) * m).sum(0)
    x, y = np.divmod(np.arange(sums.size), k)
    other = mine[x] != y
    return pa.table([pa.array([lang] * int(other.sum()), pa.string()), names.take(pa.array(mine[x][other])), names.take(pa.array(y[other])), pa.array(sums.reshape(-1)[other])], names=SUMS.names)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's term shares lie from other sources', and its own terms.

    Null texts, languages and sources count as empty ones.  Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a
    language keeps the terms of at least ``least_docs`` of its documents.  Part ``pair`` has every other source of the language
    with the summed absolute difference of the shares (0 without kept terms); part ``term`` the ``top`` terms that the source has
    with a larger share than its language.  Ranks go by falling value, then by the item's UTF-8 bytes.  Sources without terms, or
    with empty texts only, have shares too.  Repeated rows count each; an empty table gives an empty result; other columns
    are not read.
    """
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text_bytes(text).alias("text"))
    with scratch() as s:
        groups = cut(src.groupBy("lang", "source").agg(F.count("*").alias("rows")))
        counts = stage(src.mapInArrow(lambda it: _counts(it, chunk), COUNTS))
        kept = cut(counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_docs).select("lang", "term"))
        by_source = counts.join(kept, ["lang", "term"]).select("lang", "term", F.inline("by")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
        terms = stage(by_source.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by")).withColumn("id", F.md5(F.to_json("by").cast("binary"))))
        distinct = stage(terms.groupBy("lang", "id").agg(F.count("*").alias("times"), F.first("by").alias("by")))
        entries = distinct.select("lang", "id", "times", F.inline("by"))

        sizes = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
        per_lang = distinct.groupBy("lang").agg(F.sum("times").alias("terms"), F.count("*").alias("vectors"))
        lang_total = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        known = groups.join(per_lang, "lang", "left").join(lang_total, "lang", "left").join(sizes, ["lang", "source"], "left")
        known = cut(known.na.fill(0, ["terms", "vectors", "total", "lang_total"]))

        result = _pairs(known, distinct, shard, tile).unionByName(_terms(known, entries, terms, top))
        return s.keep(cut(result))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= top) if top else out).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pairs(known: DataFrame, distinct: DataFrame, shard: int, tile: int) -> DataFrame:
    """Every ordered pair of sources: sums over the distinct vectors, by shards of vectors and tiles of pairs."""
    n = known.groupBy("lang").agg(F.count("*").alias("k"), F.first("vectors").alias("vectors"))
    n = n.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("vectors") / shard))).withColumn("tiles", F.ceil(F.col("k") / F.greatest(F.lit(1), F.floor(F.lit(tile) / F.col("k")))))
    n = cut(n.select("lang", "k", "shards", "tiles"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    vectors = distinct.join(n, "lang").select("lang", F.pmod(F.xxhash64("id"), "shards").alias("shard"), every("tiles").alias("tile"), "by", "times")
    sources = known.where("terms > 0").join(n, "lang").select("lang", "source", (F.col("total") + PRIOR * F.col("terms")).alias("below"), "shards", every("tiles").alias("tile"))
    sources = sources.select("lang", "source", "below", "tile", every("shards").alias("shard"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _pair_sums(key, left, right, tile)

    key = ["lang", "shard", "tile"]
    sums = vectors.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(run, SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a language without kept terms: all its pairs, with 0
    blank = known.where("terms = 0").select("lang", "source")
    others = blank.join(blank.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return _ranked(sums.unionByName(others), "pair")


def _terms(known: DataFrame, entries: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more of than its language: judged by distinct vector, ranked by original term."""
    whole = entries.groupBy("lang", "id").agg(F.sum("n").alias("lang_n"))
    judged = entries.join(whole, ["lang", "id"]).join(known, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    judged = judged.select("lang", "id", "source", (p - q).alias("value")).where("value > 0")
    # of the terms of one vector, which have one value, only the first ``top`` can be ranked
    few = terms.select("lang", "id", F.col("term").alias("item")).withColumn("k", F.row_number().over(Window.partitionBy("lang", "id").orderBy("item"))).where(F.col("k") <= top)
    return _ranked(judged.join(few.drop("k"), ["lang", "id"]), "term", top)


def oracle(table: str = "documents", least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The audit in DuckDB SQL, every pair and every kept term in turn."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * terms))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS x FROM {table}),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(terms, 0) AS terms, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) USING (lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
lang_total AS (SELECT lang, sum(n) AS total FROM whole GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, {p('coalesce(n.n, 0)', 'total')} AS p, coalesce(n.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
above AS (SELECT p.lang, p.source, p.term AS item, (p.p - {p('whole.n', 'lang_total.total')})::BIGINT AS value FROM p JOIN whole USING (lang, term) JOIN lang_total USING (lang) JOIN v USING (lang) WHERE p.n > 0)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM above WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}
"""
