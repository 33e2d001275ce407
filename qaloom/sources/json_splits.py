"""Large JSON documents read by many tasks: one long list or map is cut into its elements across file splits.

Spark's text reader cuts files at closing braces, so that a file has as many splits as its size asks for.  Whether a brace or comma
counts depends on all text before it: on the parity of quotes and the depth of brackets.  Both are prefix sums.  A first pass gives
each split's effect, the change of parity and the change of depth for either parity at its start; effects are combined over a file's
splits (a row each, the only thing that reaches the driver); a second pass starts every split in its true state and cuts elements at the
commas of the wanted depth.  An element that lies in several splits is put together by a shuffle of these parts alone.

A file that does not end where it began, at depth 0 outside a string, is no document and has no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_EFFECT = "path string, block long, parity int, outside long, inside long, head string"
_PART = "path string, block long, container long, comma long, text binary, open_before boolean, open_behind boolean, key string"
_TOTAL = "path string, block long, containers long, commas long"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(path, block, value)``: what stands between closing braces, in order inside a split."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """Consecutive pieces of one split as bytes, each with its brace again."""
    for b in batches:
        if not b.num_rows:
            continue
        block, codes = b.column(1).to_numpy(), b.column(0).dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((block[1:] != block[:-1]) | (codes[1:] != codes[:-1])) + 1
        for a, z in zip([0, *new], [*new, b.num_rows], strict=True):
            yield b.column(0)[int(a)].as_py(), int(block[a]), b"".join(v.as_py() + b"}" for v in b.column(2).slice(a, z - a))


def _marks(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without escapes, the parity of quotes up to each, and the step of depth that each would make outside a string."""
    a = np.frombuffer(_ESCAPE.sub(b"\0\0", buf), np.uint8)
    step = np.isin(a, (91, 123)).astype(np.int8) - np.isin(a, (93, 125)).astype(np.int8)
    return a, (np.cumsum(a == 34) & 1).astype(np.int8), step


def _effects(batches):
    """The effect of each split: one row for all its runs, which add up in order."""
    now: list | None = None

    def row():
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now, kinds, strict=True)], names=[x.split()[0] for x in _EFFECT.split(", ")])

    for path, block, buf in _runs(batches):
        _, parity, step = _marks(buf)
        effect = int(step[parity == 0].sum()), int(step[parity == 1].sum())
        if now is None or (path, block) != (now[0], now[1]):
            if now is not None:
                yield row()
            now = [path, block, 0, 0, 0, ""]
        p = now[2]
        now[2:5] = p ^ int(parity[-1]), now[3] + effect[p], now[4] + effect[1 - p]
        now[5] = now[5] or buf.lstrip()[:1].decode("latin-1")
    if now is not None:
        yield row()


class _Splits:
    """The state in which each split starts, and every file's wanted depth (0: no document)."""

    def __init__(self, effects: list, in_objects: int, in_lists: int):
        self.start: dict[tuple[str, int], tuple[int, int]] = {}
        self.level: dict[str, int] = {}
        now: dict[str, tuple[int, int]] = {}
        for path, block, parity, outside, inside, head in effects:
            p, d = now.get(path, (0, 0))
            self.start.setdefault((path, block), (p, d))
            if not self.level.get(path) and head:
                self.level.setdefault(path, {"[": in_lists, "{": in_objects}.get(head, 0))
            now[path] = (p ^ parity, d + (inside if p else outside))
        # the reader does not say whether a brace stands at the very end: one too many is the reader's
        for path, (p, d) in now.items():
            if p or d not in (0, -1):
                self.level[path] = 0


def _parts(batches, splits, totals: bool):
    """The elements' parts, or the numbers of containers and commas, of every split."""
    last, state, counts, tail = None, (0, 0), [0, 0], False

    def total():
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([counts[0]], pa.int64()), pa.array([counts[1]], pa.int64())], names=[x.split()[0] for x in _TOTAL.split(", ")])

    for path, block, buf in _runs(batches):
        level = splits.level.get(path, 0)
        if not level:
            continue
        if (path, block) != last:
            if totals and last:
                yield total()
            last, state, counts = (path, block), splits.start[path, block], [0, 0]
        a, parity, step = _marks(buf)
        free = parity == state[0]  # an even number of quotes before: outside a string
        free &= a != 34
        step = np.where(free, step, 0)
        before = state[1] + np.cumsum(step) - step
        opens = np.flatnonzero((step > 0) & (before == level - 1))
        closes = np.flatnonzero((step < 0) & (before == level))
        commas = np.flatnonzero((a == 44) & free & (before == level))
        edges = np.concatenate([opens, closes, commas])
        kinds = np.concatenate([np.full(len(opens), 0), np.full(len(closes), 1), np.full(len(commas), 2)])
        order = np.argsort(edges)
        edges, kinds = edges[order].tolist(), kinds[order].tolist()
        rows, at, inside = [], 0, state[1] >= level
        started = inside  # the first part goes on from the run before
        for edge, kind in [*zip(edges, kinds, strict=True), (len(buf), 3)]:
            if inside:
                rows.append((counts[0], counts[1], buf[at:edge], started, kind == 3, None))
            if kind == 0:
                counts[0] += 1
                m = _KEY.search(buf[:edge]) if level > 1 else None
                rows.append((counts[0], counts[1], None, False, False, m[1].decode() if m else ""))
            counts[1] += kind == 2
            inside, started, at = kind in (0, 2), False, edge + 1
        state = (int(parity[-1]) ^ state[0], int(before[-1] + step[-1]))
        if not totals and rows:
            k = len(rows)
            columns = [pa.array([path] * k), pa.array([block] * k, pa.int64())]
            kinds_ = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_, strict=True))], names=[x.split()[0] for x in _PART.split(", ")])
    if totals and last:
        yield total()


def elements(spark: SparkSession, path: str, boxes: bool = False) -> DataFrame:
    """``(path, key, pos, text)``: the elements of every file's document, as JSON texts in order.

    Of a list its items; of a map its ``"name": value`` pairs, or, with ``boxes``, the items of the lists in it, ``key`` being
    the list's name and ``pos`` counting anew in each.  Files that hold something else have none.  ``pos`` counts every item.
    """
    pieces = _pieces(spark, path)
    # a row each split, as many as the driver has planned for this read
    effects = sorted(map(tuple, pieces.mapInArrow(_effects, _EFFECT).collect()))
    splits = _Splits(effects, 2 if boxes else 1, 1)

    parts = pieces.mapInArrow(lambda it: _parts(it, splits, False), _PART)
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a file's splits
    totals = pieces.mapInArrow(lambda it: _parts(it, splits, True), _TOTAL)
    base = totals.select("path", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for c, n in (("containers", "c0"), ("commas", "k0"))])
    placed = parts.join(base, ["path", "block"]).select("path", "block", (F.col("container") + F.col("c0")).alias("container"), (F.col("comma") + F.col("k0")).alias("comma"), "text", "open_before", "open_behind", "key", F.monotonically_increasing_id().alias("id"))
    starts = placed.where("text is null").groupBy("path", "container").agg(F.min("comma").alias("first"), F.first("key").alias("key"))
    whole = placed.where("text is not null and not open_before and not open_behind").select("path", "container", "comma", "text")
    torn = placed.where("text is not null and (open_before or open_behind)").groupBy("path", "container", "comma").agg(F.sort_array(F.collect_list(F.struct("block", "id", "text"))).alias("p"))
    mended = torn.select("path", "container", "comma", F.aggregate("p", F.lit(bytearray()), lambda s, x: F.concat(s, x["text"])).alias("text"))
    both = whole.unionByName(mended).join(starts, ["path", "container"])
    out = both.select("path", "key", (F.col("comma") - F.col("first")).alias("pos"), F.decode("text", "UTF-8").alias("text"))
    return out.where(F.length(F.regexp_replace("text", r"^\s+", "")) > 0)


def head_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, head)``: every file's first character that is no blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"^\s*(\S)", 1).alias("head"), F.col("_metadata.file_block_start").alias("block"))
    found = lines.where("head <> ''").withColumn("id", F.monotonically_increasing_id())
    return found.groupBy("path").agg(F.min_by("head", F.struct("block", "id")).alias("head"))


def named(text: Column, kind: str) -> Column:
    """A map of one entry from a ``"name": value`` pair."""
    return F.from_json(F.concat(F.lit("{"), text, F.lit("}")), f"map<string, {kind}>")
