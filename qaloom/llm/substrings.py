"""Removal of repeated word runs through fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words, the index.  ``BLOCK`` is (window + 1) / 2, so that any
window of ``window`` words, wherever it starts, holds one whole block of its own document.  All documents probe the index
with every rolling window of ``BLOCK`` words; a block that another document's rolling window hits is an anchor.  Hits
are then extended to both sides, in all ways that give a whole window, and windows with equal words meet the smallest
document that has them; consecutive windows join to maximal repeated spans.

No pair of documents is ever formed: a hit, and later an extended window, is one entry in a list of its chunk (documents of
about ``CHUNK`` words), with what the chunk's documents have in common about it.  Lists are sorted, packed and dealt by
ranges of the hash; a range is settled in one task and answered chunk by chunk.  A passage that a third of all documents
share is thus one entry a chunk.  Block hashes (62 bits) only choose what is extended; extended windows are told apart by 96
bits of two unlike hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, clear_of, scratch, stage, text_bytes

WINDOW = 13
#: Words of the documents that make up a chunk, but for one longer document.
CHUNK = 1 << 20
#: A longer text is handled in pieces of this many bytes.
PIECE = 4 << 20
#: Bytes of lists that meet in one range.
RANGE_BYTES = 16 << 20
LAST_ID = (1 << 63) - 1
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FLAGS = np.uint64(3)
_BLANK, _TOKEN = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")


def pieces(text: bytes, window: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """``(first word, words of its own, bytes)`` of a text's pieces; the bytes go on for ``window - 1`` words."""
    at = pos = 0
    while True:
        end = len(text)
        if pos + size < end and (m := _BLANK.search(text, pos + size)):
            end = m.start()
        n, stop = len(text[pos:end].split()), end
        for _, m in zip(range(window - 1), _TOKEN.finditer(text, end), strict=False):
            stop = m.end()
        yield at, n, text[pos:stop]
        at, pos = at + n, end
        if pos >= len(text):
            return


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return h[:, 0], h[:, 1]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= _PRIME
        out += h[k : k + len(out)]
        out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64 bits, the first one sorted, as a compressed list."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = [c.astype(np.int64).view(np.uint8).reshape(-1, 8).T for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpacked(z: bytes, columns: int = 1) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8 * columns, -1)
    out = [np.ascontiguousarray(planes[8 * i : 8 * i + 8].T).reshape(-1).view(np.uint64) for i in range(columns)]
    return [np.cumsum(out[0], dtype=np.uint64), *(c.view(np.int64) for c in out[1:])]


def _dealt(cid: int, columns: list[np.ndarray], ranges: int) -> pa.Table:
    """``(part, cid, z)``: a list cut into its ranges of the hash."""
    part = (columns[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    at = np.flatnonzero(np.diff(part, prepend=np.uint64(ranges)))
    z = [packed([c[a:b] for c in columns]) for a, b in zip(at, [*at[1:], len(part)], strict=True)]
    return pa.table([pa.array(part[at].astype(np.int64)), pa.array(np.full(len(at), cid)), pa.array(z, pa.binary())], names=["part", "cid", "z"])


_DEALT, _ANSWER = "part long, cid long, z binary", "cid long, z binary"


def _gathered(t: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All lists of a range, and the chunk of each entry."""
    got = [unpacked(z, columns) for z in t.column("z").to_pylist()]
    cid = np.repeat(t.column("cid").to_numpy(), [len(x[0]) for x in got])
    return cid, [np.concatenate(c) for c in zip(*got, strict=True)]


def _answers(cid: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """``(cid, z)`` of entries that are sorted by hash."""
    order = np.argsort(cid, kind="stable")
    cid, columns = cid[order], [c[order] for c in columns]
    at = np.flatnonzero(np.diff(cid, prepend=cid[0] - 1 if len(cid) else 0))
    z = [packed([c[a:b] for c in columns]) for a, b in zip(at, [*at[1:], len(cid)], strict=True)]
    return pa.table([pa.array(cid[at], pa.int64()), pa.array(z, pa.binary())], names=["cid", "z"])


def _cut_texts(batches, names: list[str], window: int, chunk: int, piece: int):
    """``cid, rid, at, n, id, z`` and the kept columns: a row for each piece; a chunk has the first row's ``rid`` as ``cid``."""
    c = zstandard.ZstdCompressor(level=1)
    cid, held = None, 0
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        rows = []
        for i, (rid, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
            if cid is None or held >= chunk:
                cid, held = rid, 0
            own = b.column(1)[i].as_py()
            for at, n, part in pieces(text.as_buffer().to_pybytes(), window, piece):
                for column, v in zip(out, (cid, rid, at, n, own, c.compress(part)), strict=True):
                    column.append(v)
                rows.append(i)
                held += n
        kinds = [pa.int64()] * 5 + [pa.binary()]
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *(x.take(take) for x in b.columns[3:])], names=names)


def _probes(batches, window: int, block: int, ranges: int, chunk: int):
    """The rolling windows of every chunk: hash, whether one is a block of the index, whether several texts have it."""
    d = zstandard.ZstdDecompressor()

    def flush(cid, hashes, rids, blocks):
        h, rid = np.concatenate(hashes) & ~_FLAGS, np.repeat(np.array(rids, np.int64), [len(x) for x in hashes])
        order = np.argsort(h)
        h, rid, is_block = h[order], rid[order], np.concatenate(blocks)[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shared = np.minimum.reduceat(rid, at) != np.maximum.reduceat(rid, at)
        flags = np.logical_or.reduceat(is_block, at).astype(np.uint64) * np.uint64(2) + shared
        return _dealt(cid, [h[at] | flags], ranges).to_batches()

    cid, held, hashes, rids, blocks = None, 0, [], [], []
    for b in batches:
        for now, rid, at, z in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            if hashes and (now != cid or held >= chunk):
                yield from flush(cid, hashes, rids, blocks)
                held, hashes, rids, blocks = 0, [], [], []
            cid = now
            words = d.decompress(z.as_buffer()).split()
            if len(words) < window:
                continue
            h = rolled(word_hashes(words)[0], block)
            hashes.append(h)
            rids.append(rid)
            blocks.append((np.arange(at, at + len(h)) % block) == 0)
            held += len(h)
    if hashes:
        yield from flush(cid, hashes, rids, blocks)


def _anchors(t: pa.Table) -> pa.Table:
    """Of one range the hashes of blocks that some other text's rolling window hits, for each chunk that has them."""
    cid, (v,) = _gathered(t, 1)
    h = v & ~_FLAGS
    order = np.argsort(h, kind="stable")
    h, v, cid = h[order], v[order], cid[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.concatenate([at, [len(h)]]))
    flags = np.bitwise_or.reduceat(v & _FLAGS, at)
    good = np.repeat((flags >= 2) & ((n > 1) | (flags == 3)), n)
    return _answers(cid[good], [h[good]])


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("rid", "ascending"), ("at", "ascending")])


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == wanted


def _extended(left: pa.Table, right: pa.Table, window: int, block: int, ranges: int) -> pa.Table:
    """Every hit of a chunk's texts extended to whole windows, with the smallest and the largest id that have one."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpacked(z)[0] for z in right.column("z").to_pylist())]))
    d, keys = zstandard.ZstdDecompressor(), [[], [], []]
    for n, own, z in zip(*(left.column(c).to_pylist() for c in ("n", "id", "z")), strict=True) if len(known) else ():
        lo, hi = word_hashes(d.decompress(z).split())
        starts = min(n, len(lo) - window + 1)
        if starts < 1:
            continue
        hits = np.concatenate([[0], np.cumsum(_found(known, rolled(lo, block) & ~_FLAGS))])
        at = np.flatnonzero(hits[window - block + 1 :][:starts] > hits[:starts])
        if len(at):
            for column, v in zip(keys, (rolled(lo, window)[at], (rolled(hi, window)[at] >> np.uint64(32)).astype(np.int64), np.full(len(at), own)), strict=True):
                column.append(v)
    if not keys[0]:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["part", "cid", "z"])
    k1, k2, own = (np.concatenate(c) for c in keys)
    k1, k2, least, most = _least(k1, k2, own, own)
    return _dealt(left.column("cid")[0].as_py(), [k1, k2, least, most], ranges)


def _runs(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both keys, and where each run of equal keys begins in that order."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _least(k1, k2, low, high) -> tuple[np.ndarray, ...]:
    order, at = _runs(k1, k2)
    return k1[order][at], k2[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def _owners(t: pa.Table) -> pa.Table:
    """Of one range the smallest id of every extended window, for each chunk that has it in a text with a larger id."""
    cid, (k1, k2, low, high) = _gathered(t, 4)
    order, at = _runs(k1, k2)
    first = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.concatenate([at, [len(order)]])))
    gone = first < high[order]
    order = order[gone]
    return _answers(cid[order], [k1[order], k2[order], first[gone]])


def _removed(left: pa.Table, right: pa.Table, window: int, names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """``keep, n_words, n_removed, spans, kept`` of a chunk's texts."""
    got = [unpacked(z, 3) for z in right.column("z").to_pylist()]
    k1, k2, first = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((k2, k1))
    k1, k2, first = k1[order], k2[order], first[order]
    most = int(np.diff(np.flatnonzero(np.concatenate([[True], k1[1:] != k1[:-1], [True]]))).max()) if len(k1) else 0
    left, d = _ordered(left), zstandard.ZstdDecompressor()
    rows, n_words, spans, kept = [], [], [], []
    last, reach, parts = None, 0, []
    for i, (rid, at, n, own, z) in enumerate(zip(*(left.column(c).to_pylist() for c in ("rid", "at", "n", "id", "z")), strict=True)):
        words = d.decompress(z).split()
        if rid != last:
            if parts:
                kept.append(b" ".join(parts))
            last, reach, parts = rid, 0, []
            rows.append(i)
            n_words.append(0)
            spans.append([])
        n_words[-1] += n
        starts = min(n, len(words) - window + 1)
        gone = np.zeros(max(0, starts), bool)
        if len(k1) and starts > 0:
            lo, hi = word_hashes(words)
            a, b = rolled(lo, window)[:starts], (rolled(hi, window)[:starts] >> np.uint64(32)).astype(np.int64)
            place = np.searchsorted(k1, a)
            for step in range(most):
                there = np.minimum(place + step, len(k1) - 1)
                gone |= (k1[there] == a) & (k2[there] == b) & (first[there] < own)
        for s in (np.flatnonzero(gone) + at).tolist():
            if spans[-1] and s <= spans[-1][-1][1]:
                spans[-1][-1][1] = s + window
            else:
                spans[-1].append([s, s + window])
        out, pos = [], max(at, min(reach, at + n))
        for s, e in spans[-1]:
            if e > at and s < at + n:
                out += words[pos - at : max(pos, s) - at]
                pos = max(pos, min(e, at + n))
        out += words[pos - at : n]
        reach = spans[-1][-1][1] if spans[-1] else 0
        parts += [b" ".join(out)] if out or not parts else []
        if len(parts) > 1 and not parts[0]:
            parts.pop(0)
    if parts:
        kept.append(b" ".join(parts))
    keep = left.take(pa.array(rows, pa.int64())).select(names[: len(names) - 4])
    n_removed = [sum(e - s for s, e in x) for x in spans]
    own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], kinds[-2]), pa.array([x.decode() for x in kept], kinds[-1])]
    return pa.table([*keep.columns, *own], names=names)


def remove_repeated_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, doc_id: str = "doc_id", window: int = WINDOW, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """``keep`` columns plus ``n_words, n_removed, spans, kept`` of every row.

    Words stand between ASCII blanks and count unchanged.  A word goes if a run of ``window`` words that covers it also starts in a
    row with a smaller ``doc_id`` (an integer; null counts as the largest); rows with equal ids, and the row itself, do not make a
    repeat.  Runs are judged on the input.  ``spans`` are the maximal removed runs as word numbers, ``kept`` has the other words, joined
    by one blank.  A null or empty text has no words; an empty table gives an empty result; repeated rows stay rows of their own.
    A kept column that is named like a new one gets an underscore.  A text of any length is handled piece by piece.
    The result reads tables in the shared folder: call this in a ``scratch`` block and write the result before its end.
    """
    docs, keep = clear_of(docs, keep or ["doc_id"], ["n_words", "n_removed", "spans", "kept"])
    block = (window + 1) // 2
    inner = [f"__k{i}" for i in range(len(keep))]
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), text_bytes(text).alias("z"), *[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)])
    longs = [T.StructField(n, T.LongType()) for n in ("cid", "rid", "at", "n", "id")]
    schema = T.StructType([*longs, T.StructField("z", T.BinaryType()), *src.schema.fields[3:]])
    names = schema.names
    texts = stage(src.mapInArrow(lambda it: _cut_texts(it, names, window, chunk, piece), schema))
    total = texts.agg(F.sum("n")).first()[0] or 0
    ranges = max(8, -(-8 * total // RANGE_BYTES))
    pieces_of = texts.select("cid", "rid", "at", "n", "id", "z")

    with scratch() as s:
        probes = texts.select("cid", "rid", "at", "z").mapInArrow(lambda it: _probes(it, window, block, ranges, chunk), _DEALT)
        anchors = stage(probes.groupBy("part").applyInArrow(_anchors, _ANSWER))
        windows = _both(pieces_of, anchors, lambda a, b: _extended(a, b, window, block, ranges), _DEALT)
        owners = s.keep(stage(windows.groupBy("part").applyInArrow(_owners, _ANSWER)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    out = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())]
    final = T.StructType([*schema.fields[6:], *out])
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
    done = _both(texts, owners, lambda a, b: _removed(a, b, window, final.names, kinds), final)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)], "n_words", "n_removed", "spans", "kept")


def _both(texts: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``f`` of every chunk's texts and the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right)

    return texts.groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(run, schema)


def oracle(table: str = "documents", window: int = WINDOW) -> str:
    """The query in DuckDB SQL, from a digest of every window."""
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST_ID}) AS o, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {table}),
win AS (SELECT r, o, i, md5(array_to_string(w[i:i+{window - 1}], ' ')) AS h FROM (SELECT r, o, w, unnest(range(1, len(w) - {window - 2})) AS i FROM t WHERE len(w) >= {window})),
gone AS (SELECT r, i FROM (SELECT r, o, i, min(o) OVER (PARTITION BY h) AS least FROM win) WHERE least < o),
covered AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS k FROM gone),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM t),
rest AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS s FROM words ANTI JOIN covered USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN rest USING (r)
"""
