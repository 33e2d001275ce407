"""Exact removal of repeated windows by a depth-limited, most-significant-digit-first radix sort of sparse suffixes.

Suffixes count as equal once they agree through ``window`` bytes (or words), so none is looked at deeper than that.  Sparse:
one suffix stands for all windows that share an anchor, the place of a window's smallest ``gram``-byte hash (leftmost of
equals).  An anchor depends on the window's bytes only, so equal windows have their anchors at equal offsets, and a window's bytes can
be read in one fixed order: from the anchor on, then to both sides.  Digits are taken in that order:

* The first digit is the anchor's gram, which all windows of the anchor share.
* Each further pass splits a class of windows into narrower classes of neighbours, down to one window.  A class's next
  digit is what its windows share beyond the bytes of earlier passes; its key is the digest of the parent's key and that
  digit, so equal keys are equal prefixes.
* After each pass a group of one is dropped.  Cells with equal keys that also agree in all other bytes their own windows touch
  are repeated whole and accepted; of these one goes on.  In the last pass the equal groups are exactly the repeated windows.

Nothing has to be put in order inside a digit, so the distribution step is grouping by key: keys are 128-bit digests, counted
with map-side combination and joined back, and a passage that a third of all documents share is one counter and not one
task's list.  Texts are compressed and dealt by row once; every pass over them is a join without a text shuffle, and
a long text's cells go in blocks.

The same passes run over bytes and over words, each word being one 64-bit hash in place of a byte: windows then are runs
of words, whatever blanks stand between them.
"""

from __future__ import annotations

import re
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .common import WORD, cut, drop, parts_for, release_shuffles, scratch, stage, text_bytes, written

WINDOW = 400
GRAM = 100
#: Class widths after the first pass, in windows.
WIDTHS = (38, 5, 1)
#: Repeated runs of this many words are found beside repeated byte windows.
WORDS = 50
#: Class widths in runs of words, as many passes.
WORD_WIDTHS = (12, 4, 1)
CHUNK = 1 << 18
#: Bytes of text in a partition, which grows once there would be more partitions than that.
PART_BYTES, MOST_PARTS = 32 << 20, 100_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) < n:
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for name, base in (("up", _PRIME), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            cache[name] = np.cumprod(p)
    return cache["up"][:n], cache["down"][:n]


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, from prefix sums of a polynomial modulo 2^64, mixed."""
    n = len(buf)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the documents of ``buf``, which end at ``ends``.

    Returns (document, place, first window, last window, gram hash), all places counted from the start of ``buf``.
    """
    n, w = len(buf), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(buf, gram)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-len(key) % w, ~np.uint64(0), np.uint64)
    rows = np.concatenate([key, pad]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(key) - w + 1
    place = (np.minimum(after[:count], before[w - 1 : w - 1 + count]) & _LOW).astype(np.int64)
    start = np.arange(count)
    doc = np.searchsorted(ends, start, "right")
    ok = start + window <= ends[np.minimum(doc, len(ends) - 1)]
    start, doc, place = start[ok], doc[ok], place[ok]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return doc[first], place[first], start[first], start[last], h[place[first]]


def _decoded(column: pa.Array):
    """The texts one by one, so that a batch of them never lies decompressed in memory."""
    d = zstandard.ZstdDecompressor()
    for z in column:
        yield d.decompress(z.as_buffer()) if z.is_valid else b""


def _units(text: bytes, words: bool):
    """What windows are counted in: the bytes of a text, or a hash of each of its words (between ASCII blanks)."""
    if not words:
        return text
    w = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


class Unit(NamedTuple):
    """One kind of windows: bytes or words, the window's length, the gram's, and the class width of every pass."""

    words: bool
    window: int
    gram: int
    widths: tuple[int, ...]


FOUND = "u boolean, kh long, rid long, m long, s0 long, s1 long"


def _anchor_rows(batches, units: list[Unit]):
    """One row for all windows ``s0..s1`` of an anchor at ``m``; ``kh`` is the hash of its gram."""
    names = ["u", "kh", "rid", "m", "s0", "s1"]

    def flush(unit, rids, parts):
        buf = np.concatenate(parts) if unit.words else np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        ends = np.cumsum(size)
        doc, place, lo, hi, h = anchors(buf, ends, unit.window, unit.gram)
        shift = np.array([r[1] for r in rids])[doc] - (ends - size)[doc]
        columns = (h.view(np.int64) ^ unit.words, np.array([r[0] for r in rids], np.int64)[doc], place + shift, lo + shift, hi + shift)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), unit.words)), *(pa.array(c.astype(np.int64)) for c in columns)], names=names)

    held = [([], [], [0]) for _ in units]
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), _decoded(b.column(1)), strict=True):
            for unit, (rids, parts, size) in zip(units, held, strict=True):
                whole = _units(text, unit.words)
                # a text longer than a chunk goes in overlapping chunks, each with the windows that start in it
                for at in range(0, len(whole) - unit.window + 1, CHUNK):
                    piece = whole[at : at + CHUNK + unit.window - 1]
                    rids.append((rid, at))
                    parts.append(piece)
                    size[0] += len(piece)
                    if size[0] >= CHUNK:
                        yield flush(unit, rids, parts)
                        rids.clear(), parts.clear(), size.__setitem__(0, 0)
    for unit, (rids, parts, _) in zip(units, held, strict=True):
        if parts:
            yield flush(unit, rids, parts)


#: A cell: its class's key, that key with all bytes of its windows, its windows, its class's first and last window.
CELL = T.StructType([T.StructField("u", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("k1", "k2", "o1", "o2", "rid", "s0", "s1", "l", "r"))])


def _cell_rows(batches, units: dict[bool, Unit], step: int):
    """The cells of pass ``step`` inside the listed cells (0: these themselves, their keys being the gram's hash)."""
    digest, pack = xxhash.xxh3_128_digest, struct.Struct("<qq").pack
    last, text, view = None, b"", {}
    for b in batches:
        lists = b.column(2)
        flat, offsets = lists.values, lists.offsets.to_numpy()
        u, *numbers = (flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(7))
        out, keys = [], []
        for i, rid in enumerate(b.column(0).to_pylist()):
            if rid != last:
                last, text, view = rid, next(_decoded(b.column(1).slice(i, 1))), {}
            for j in range(offsets[i], offsets[i + 1]):
                lo, hi, l, r, k1, k2 = (c[j] for c in numbers)
                unit = units[u[j]]
                if u[j] not in view:
                    view[u[j]] = memoryview(_units(text, unit.words)).cast("B")
                t, w, n = view[u[j]], unit.window, 8 if unit.words else 1
                if not step:
                    out.append((u[j], k1, k2, rid, lo, hi, l, r))
                    keys.append(digest(t[lo * n : (hi + w) * n], r - lo))
                    continue
                width, parent = unit.widths[step - 1], pack(k1, k2)
                for c in range((r - hi) // width, (r - lo) // width + 1):
                    right = r - c * width
                    left = max(l, right - width + 1)
                    # the digit: what these windows share beyond the parent's [r, l + window); at first all they share
                    fresh = (t[right * n : (left + w) * n],) if step == 1 else (t[right * n : r * n], t[(l + w) * n : (left + w) * n])
                    key = digest(b"".join((parent, *fresh)), c * 64 + step)
                    a, z = max(left, lo), min(right, hi)
                    out.append((u[j], *struct.unpack("<qq", key), rid, a, z, left, right))
                    keys.append(digest(b"".join((key, t[a * n : right * n], t[(left + w) * n : (z + w) * n])), right - a))
                if len(out) >= 50_000:
                    yield _cells(out, keys)
                    out, keys = [], []
        if out:
            yield _cells(out, keys)


def _cells(rows: list, keys: list[bytes]) -> pa.RecordBatch:
    c = np.array(rows, np.int64)
    o = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    columns = [c[:, 0].astype(bool), c[:, 1], c[:, 2], o[:, 0], o[:, 1], *(c[:, i] for i in range(3, 8))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=CELL.names)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [a, b) of the bytes in any of [starts, ends)."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], ends[order]
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return a[at], reach[np.concatenate([at[1:], [len(a)]]) - 1]


def _merged_rows(batches):
    """Of ``rid, u`` and a list of cells the maximal intervals of consecutive windows."""
    for b in batches:
        lists = b.column(2)
        a, z = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        offsets = lists.offsets.to_numpy()
        got = [_merge(a[x:y], z[x:y] + 1) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        row = pa.array(np.repeat(np.arange(len(got)), [len(x) for x, _ in got]))
        ends = [np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(ends[0]), pa.array(ends[1] - 1)], names=["rid", "u", "s0", "s1"])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _kept_rows(batches, window: int, words: int, cut_words: bool, as_text: bool, names: list[str]):
    none = np.zeros(0, np.int64)
    for b in (w.slice(at, 1000) for w in batches for at in range(0, w.num_rows, 1000)):
        lists = b.column(1)
        n_removed, n_spans, n_words, kept, size = [], [], [], [], []
        for text, cells in zip(_decoded(b.column(0)), lists, strict=True):
            size.append(len(text))
            u, s0, s1 = (cells.values.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if cells.is_valid else (none.astype(bool), none, none)
            runs, stops = s0[u], s1[u] + words
            n_words.append(int(np.subtract(*_merge(runs, stops)[::-1]).sum()) if len(runs) else 0)
            a, e = s0[~u], s1[~u] + window
            if cut_words and len(runs):
                at = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                a, e = np.concatenate([a, at[runs, 0]]), np.concatenate([e, at[stops - 1, 1]])
            if not len(a):
                n_removed.append(0)
                n_spans.append(0)
                kept.append(text)
                continue
            a, e = _merge(a, e)
            n_removed.append(int((e - a).sum()))
            n_spans.append(len(a))
            edge = np.concatenate([[0], np.stack([a, e], 1).reshape(-1), [len(text)]]).tolist()
            kept.append(b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)))
        rest = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        own = [pa.array(x, pa.int64()) for x in (size, n_removed, n_spans, n_words)]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], *own, rest], names=names)


def _dealt(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, int]:
    """The rows with compressed text, dealt by a row id, and the partitions for narrow tables.

    They are checkpointed as they are dealt: Spark remembers how a checkpointed table is partitioned, so that a join on the row
    id moves the narrow side alone.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_bytes(text)))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))
    src = docs.select(F.monotonically_increasing_id().alias("__rid"), text_bytes(text).alias("__z"), *keep)
    names = src.columns

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([c.compress(t.as_buffer()) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), z, *b.columns[2:]], names=names)

    shared_folder(spark)
    # an adaptive plan does not tell its partitioning, so this one exchange is planned without
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = src.mapInArrow(squeeze, src.schema).repartition(n, "__rid").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    release_shuffles(spark)  # the exchange's files hold all texts once more
    path = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    return written(rows, path), parts_for(spark, size)  # narrow tables are a fraction of the texts


def _refine(texts: DataFrame, active: DataFrame, units: dict[bool, Unit], step: int, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """(accepted intervals ``rid, u, s0, s1``, cells to split further) of one pass over the active cells, which are deleted.

    Cells and groups are the largest tables; what led to either goes as soon as it is written.
    """
    spark = texts.sparkSession
    with scratch() as s:
        lists = active.groupBy(F.col("rid").alias("__rid"), F.floor(F.col("s0") / CHUNK)).agg(F.collect_list(F.struct("u", "s0", "s1", "l", "r", "k1", "k2")).alias("cells"))
        joined = texts.select("__rid", "__z").join(lists.select("__rid", "cells").hint("shuffle_hash"), "__rid")
        cells = stage(joined.mapInArrow(lambda it: _cell_rows(it, units, step), CELL).coalesce(parts))
        drop(active)
        release_shuffles(spark)
        key = ["u", "k1", "k2"]
        # any member stands for its group: all have the same bytes; the firsts come from one row
        one = [F.first(c).alias(c) for c in ("rid", "s0", "s1", "l", "r")]
        groups = cells.groupBy(*key, "o1", "o2").agg(F.count("*").alias("n"), *one)
        if step == max(len(x.widths) for x in units.values()):
            twice = cut(groups.where("n > 1").select(*key), parts)
            return s.keep(cut(cells.join(twice, key).select("rid", "u", "s0", "s1"), parts)), None
        groups = stage(groups.coalesce(parts))
        release_shuffles(spark)
        twice = groups.where("n > 1").select(*key, "o1", "o2")
        accepted = cut(cells.join(twice, [*key, "o1", "o2"]).select("rid", "u", "s0", "s1"), parts)
        release_shuffles(spark)
        mixed = cut(groups.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key), parts)
        further = cut(groups.join(mixed, key).select("rid", "u", "s0", "s1", "l", "r", "k1", "k2"), parts)
        return s.keep(accepted), s.keep(further)


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS, as_text: bool = False, prefix: str = "", words: int = 0, cut_words: bool = False) -> DataFrame:
    """``keep`` columns plus ``n_bytes, n_removed, n_spans, n_repeated_words, kept`` (the remaining bytes) of every row.

    A byte goes if a ``window``-byte string that covers it also starts anywhere else, in the same text or another; all
    strings are judged on the input.  A null text counts as empty and texts under ``window`` bytes stay whole; rows that
    repeat an id are separate texts.  Overlapping repeats inside one text count.  An empty table gives an empty result.
    ``prefix`` goes before the new names where ``keep`` has columns of that name; other columns of ``docs`` are not read.
    ``as_text`` gives ``kept`` as a string without the broken characters that byte cuts can leave at an edge.
    With ``words``, ``n_repeated_words`` counts the words in runs of that many words (between ASCII blanks) that also start
    anywhere else; with ``cut_words`` these runs go too, from a run's first word's start to its last word's end.
    The result reads tables in the shared folder: call this in a ``scratch`` block and write the result before its end.
    """
    keep = keep or ["doc_id"]
    units = [Unit(False, window, gram, widths)]
    if words:
        units.append(Unit(True, words, max(1, words // 8), WORD_WIDTHS))
    by_kind = {x.words: x for x in units}
    texts, parts = _dealt(docs.select(F.col(text).alias("__text"), *keep), "__text", keep)
    found = stage(texts.select("__rid", "__z").mapInArrow(lambda it: _anchor_rows(it, units), FOUND))
    # counts are materialised before they are joined, so that both join sides are plain shuffles and a hot gram can be split
    again = cut(found.groupBy("u", "kh").agg(F.count("*").alias("n")).where("n > 1").select("u", "kh"), parts)
    span = F.when(F.col("u"), F.lit(words - units[-1].gram)).otherwise(F.lit(window - gram))
    active = found.join(again, ["u", "kh"]).select("rid", "u", "s0", "s1", (F.col("m") - span).alias("l"), F.col("m").alias("r"), F.col("kh").alias("k1"), F.lit(0).cast("long").alias("k2"))
    # written before the first pass, so that the anchors and their exchange do not lie beside its cells
    active = stage(active.coalesce(parts))
    drop(found)
    drop(again)
    release_shuffles(texts.sparkSession)
    accepted = []
    for step in range(1 + max(len(x.widths) for x in units)):
        got, active = _refine(texts, active, by_kind, step, parts)
        accepted.append(got)
        release_shuffles(texts.sparkSession)
    every = accepted[0]
    for x in accepted[1:]:
        every = every.unionByName(x)
    blocks = every.groupBy("rid", "u", F.floor(F.col("s0") / CHUNK)).agg(F.collect_list(F.struct("s0", "s1")).alias("cells")).select("rid", "u", "cells")
    merged = blocks.mapInArrow(_merged_rows, "rid long, u boolean, s0 long, s1 long")
    lists = merged.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("u", "s0", "s1")).alias("__cells"))
    joined = texts.join(lists.hint("shuffle_hash"), "__rid", "left").select("__z", "__cells", *keep)
    own = [T.StructField(prefix + n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans", "n_repeated_words")]
    schema = T.StructType([*joined.schema.fields[2:], *own, T.StructField(f"{prefix}kept", T.StringType() if as_text else T.BinaryType())])
    names = schema.names
    return joined.mapInArrow(lambda it: _kept_rows(it, window, words, cut_words, as_text, names), schema)


def oracle(table: str = "documents", window: int = WINDOW, words: int = WORDS) -> str:
    """The query's columns in DuckDB SQL, from a digest of every window: for small tables."""
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, coalesce(text, '') AS x FROM {table}),
n AS (SELECT *, octet_length(b) AS n, regexp_extract_all(x, '{WORD}') AS w FROM t),
win AS (SELECT r, i, md5(array_slice(b, i, i + {window - 1})) AS h FROM (SELECT r, b, unnest(range(1, n - {window - 2})) AS i FROM n WHERE n >= {window})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
stepped AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {window} THEN 1 ELSE 0 END AS new FROM rep),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM stepped),
runs AS (SELECT r, min(i) AS a, max(i) + {window - 1} AS e FROM numbered GROUP BY r, g),
totals AS (SELECT r, sum(e - a + 1) AS removed, count(*) AS spans FROM runs GROUP BY r),
pieces AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS s, a - 1 AS z FROM runs UNION ALL SELECT r, max(e) + 1, NULL FROM runs GROUP BY r),
rest AS (SELECT r, unhex(string_agg(substr(hex(b), 2 * s - 1, 2 * (coalesce(z, n) - s + 1)), '' ORDER BY s)) AS kept FROM pieces JOIN n USING (r) GROUP BY r),
wwin AS (SELECT r, i, md5(array_to_string(w[i:i+{words - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {words - 2})) AS i FROM n WHERE len(w) >= {words})),
wrep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM wwin) WHERE c > 1),
words AS (SELECT r, sum(least({words}, coalesce(nxt - i, {words}))) AS k FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM wrep) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(k, 0)::BIGINT AS n_repeated_words, sha256(coalesce(kept, b)) AS kept_sha256
FROM n LEFT JOIN totals USING (r) LEFT JOIN rest USING (r) LEFT JOIN words USING (r)
"""
