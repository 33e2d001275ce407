"""Line-first quality rules, in built-in functions only.

Every line is judged by rules on navigation bars, symbol runs, shouting, boilerplate phrases and missing end punctuation.
Failing lines go; a document that loses more than ``MAX_LOSS`` of its word characters goes too, and so does one that
fails the base measures (few words, or many words in repeated five-word windows).  A document's arrays live and die
inside its row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
#: Phrases of site furniture and licence notices (fixed values).
BOILERPLATE = (
    "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|click here|subscribe now|"
    "subscribe to|lorem ipsum|enable javascript|licensed under|sign up for|follow us on|share this"
)
BLANKS = " \t\n\x0b\x0c\r"
SEPARATORS = "|»•·"
END = r"""[.!?…:;"”’»)\]][\x20\x09-\x0D]*$"""
FRAGMENT_WORDS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: lambda variables are bound, columns would be copied into their uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the same text (``words``: a bound array).

    Windows are compared by chained 64-bit hashes.  Texts without a repeated window (most) end at a distinct count; the
    others sort (hash, place) pairs, so the cost is n log n for any text.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & F.coalesce(F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def cover(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, places), cover)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n <= window, F.lit(0)).otherwise(some).cast("long")


def line_fails(line: Column) -> Column:
    """True if a line with words breaks a rule; a line without words passes.  Counts are taken only where they can matter."""
    bars = count_chars(line, SEPARATORS)
    runs = F.size(F.regexp_extract_all(line, F.lit(r"([#*$%&<>]{2,})"), F.lit(0)))
    shouts = F.size(F.regexp_extract_all(line, F.lit(r"(!!)"), F.lit(0)))
    phrases = let(F.lower(line), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE.split("|")]))
    return let(
        F.size(words_of(line)),
        lambda n: (n > 0)
        & (
            ((n <= FRAGMENT_WORDS) & ~line.rlike(END))
            | let(bars, lambda b: (b >= 3) & (4 * b >= n))
            | ((count_chars(line, "#*$%&<>") >= 6) & (runs >= 3) & (5 * runs >= n))
            | (line.contains("!!") & (shouts >= 3) & (5 * shouts >= n))
            | phrases
        ),
    )


def measures(text: Column, max_loss: float = MAX_LOSS, clean: str = "clean_text", prefix: str = "") -> Column:
    """A struct of all that ``measure`` returns; every part is computed once, as bound variables of nested lambdas."""
    solid = lambda x: F.length(F.translate(x, BLANKS, "")).cast("long")

    def of(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        dup = let(F.filter(lines, lambda x: solid(x) > 0), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        per_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
        rest = F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")
        first = F.struct(per_words.alias("w"), solid(t).alias("chars"), count_chars(t, "#*$%&|<>").cast("long").alias("symbols"), dup.alias("dup"), rest.alias("rest"))
        return let(let(first, lambda m: F.struct(m.alias("m"), (m["chars"] - solid(m["rest"])).alias("lost"), _base_failed(m).alias("failed"))), named)

    def named(x: Column) -> Column:
        m = x["m"]
        own = {"n_words": m["w"]["n"], "word_chars": m["chars"], "n_symbols": m["symbols"], "n_dup_lines": m["dup"], "n_repeat_words": m["w"]["r"], "lost_chars": x["lost"], "base_failed": x["failed"]}
        kept = ~x["failed"] & (x["lost"] <= m["chars"] * F.lit(max_loss))
        return F.struct(*(v.alias(prefix + k) for k, v in own.items()), kept.alias(f"{prefix}kept"), m["rest"].alias(clean))

    return let(F.coalesce(text, F.lit("")), of)


def _base_failed(m: Column) -> Column:
    return (m["w"]["n"] < MIN_WORDS) | (100 * m["w"]["r"] > MAX_REPEAT_PERCENT * m["w"]["n"])


def measure(docs: DataFrame, text: str = "text", clean: str | None = "clean_text", max_loss: float = MAX_LOSS, prefix: str = "") -> DataFrame:
    """``docs`` plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept``.

    ``clean`` names an extra column with the text without its failing lines (None: no such column).  A null or empty text
    has no words, fails the base rule and is not kept.  Repeated rows are judged alike, an empty table gives an empty result.
    Columns of ``docs`` with these names are replaced; ``prefix`` goes before the new names where that must not be.
    """
    one = measures(F.col(text), max_loss, clean or "__clean", prefix)
    own = [f"{prefix}{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")]
    rest = [F.col(c) for c in docs.columns if c not in {*own, clean}]
    out = docs.select(*rest, F.inline(F.array(one)))
    return out if clean else out.drop("__clean")


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept rows of ``docs``, without the lines that fail; all columns stay, also those named like a measure.

    The verdict is taken inside the generator, so a text is judged once and no filter computes it again.
    """
    kept = F.filter(F.array(measures(F.col(text), clean="__clean", prefix="__q_")), lambda m: m["__q_kept"])
    judged = docs.select("*", F.inline(kept))
    return judged.select(*[F.col("__clean").alias(c) if c == text else F.col(c) for c in docs.columns])


def oracle(table: str = "documents") -> str:
    """The same measures in DuckDB SQL."""
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    solid = f"length(translate({{}}, {blank}, ''))"
    word = f"'{WORD}'"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM {table}),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lm AS (SELECT doc_id, l, {solid.format('l')} AS solid, len(regexp_extract_all(l, {word})) AS n,
  length(l) - length(translate(l, '{SEPARATORS}', '')) AS bars,
  len(regexp_extract_all(l, '[#*$%&<>]{{2,}}')) AS runs, len(regexp_extract_all(l, '!!')) AS shouts,
  regexp_matches(l, '{END}') AS ends, regexp_matches(lower(l), '{BOILERPLATE}') AS boiler FROM ln),
la AS (SELECT doc_id, count(*) FILTER (solid > 0) - count(DISTINCT l) FILTER (solid > 0) AS dup,
  coalesce(sum(solid) FILTER (n > 0 AND ((bars >= 3 AND 4 * bars >= n) OR (runs >= 3 AND 5 * runs >= n) OR (shouts >= 3 AND 5 * shouts >= n)
    OR (n <= {FRAGMENT_WORDS} AND NOT ends) OR boiler)), 0) AS lost FROM lm GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, {solid.format('text')}::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, lost::BIGINT AS lost_chars
  FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_chars <= word_chars * {MAX_LOSS} AS kept FROM m
"""
