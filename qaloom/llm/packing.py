"""Tokenised documents packed best-fit into fixed-length sequences, with bounds that certify the bin counts.

Pieces are dealt evenly over partitions of about ``PART`` pieces.  Each partition runs best-fit decreasing over its
length histogram and computes a lower bound from dual-feasible functions.  Where the bins equal the bound, the partition
is certified and done.  Partitions with a gap keep their full sequences and release the documents of all others; these
are dealt anew over fewer partitions and packed again, for as long as that saves sequences.  A partition holds lengths
and a few columns only; token ids stay outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, scratch, stage
from .wordcache import SpacedBpe

CAPACITY = 2048
PART = 1 << 16
#: The split pattern of the word-level vocabulary (a fixed value of that tokenizer file).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, SpacedBpe] = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per document its ids and one ``end_id``, cut into pieces of ``capacity`` ids: ``piece, start, length, ids`` (binary).

    ``ids`` are little-endian unsigned 32-bit.  A null or blank text has the end id alone.  ``keep`` columns are copied, one that
    is named like a new column with an underscore behind; repeated rows stay repeated, an empty table gives an empty result.
    """
    docs, keep = clear_of(docs, keep or ["doc_id"], ["piece", "start", "length", "ids"])
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, SpacedBpe(tokenizer, WORD_PIECES))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                row, piece, start, length, ids = [], [], [], [], []
                for i, got in enumerate(enc.encode(b.column(len(keep)).to_pylist())):
                    got += end
                    for k, at in enumerate(range(0, len(got), 4 * capacity)):
                        ids.append(got[at : at + 4 * capacity])
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(ids[-1]) // 4)
                kept = [c.take(pa.array(row, pa.int32())) for c in b.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def lower_bound(hist: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best dual-feasible-function bound on the bins that items with this length histogram need.

    ``hist[x]`` counts items of length x.  Families: the identity, thresholds (items above capacity - e count whole, items
    below e not at all) and the rounding functions u_k, k = 1..24.
    """
    x = np.arange(len(hist), dtype=np.int64)
    total = int((hist * x).sum())
    best = -(-total // capacity)
    sizes = np.cumsum(hist * x)
    counts = np.cumsum(hist)
    e = np.arange(1, capacity // 2 + 1)
    whole = counts[-1] - counts[capacity - e]
    middle = sizes[capacity - e] - sizes[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 25):
        y = (k + 1) * x
        u = np.where(y % capacity == 0, x * k, y // capacity * capacity)  # scaled by k
        best = max(best, -(-int((hist * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins by best fit, longest first: (bin of each item, its offset there, free space of each bin)."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if an open bin has r tokens free
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = mask >> n
        if room:
            r = n + ((room & -room).bit_length() - 1)
            b = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bins[i], offset[i] = b, capacity - r
        left = r - n
        free[b] = left
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return bins, offset, np.array(free, np.int64)


def _pack_partition(batches, number: int, capacity: int, names: list[str], base: int):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    lengths = t.column(names.index("length")).to_numpy()
    if (lengths > capacity).any() or (lengths < 1).any():
        raise ValueError("a piece is empty or longer than a sequence")
    bins, offset, free = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    gap = len(free) - bound
    sequence = (base << 56) + (part << 28) + bins
    released = (free[bins] > 0) & (gap > 0)
    extra = [pa.array(sequence), pa.array(offset), pa.array(released), pa.array(np.full(len(lengths), gap))]
    t = pa.Table.from_arrays([*t.columns, *extra], names=[*names, "sequence_id", "offset", "__released", "__gap"])
    yield from t.to_batches(max_chunksize=10_000)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, report: Callable[[dict], None] | None = None) -> DataFrame:
    """``pieces`` (a long column ``length`` in 1..capacity, any other columns) plus ``sequence_id`` and ``offset``.

    Every row comes back once, also repeated rows and rows with nulls in other columns; columns named ``sequence_id`` or ``offset``
    get an underscore.  An empty table gives an empty result.  Rounds go on until no partition has a gap to its bound or a
    round saves no sequence.  The result reads tables in the shared folder, which belong to an enclosing ``scratch`` block.  ``report`` receives per round the sequences, the partitions' summed gap to their bounds and the released pieces.
    """
    pieces, names = clear_of(pieces, pieces.columns, ["sequence_id", "offset"])
    pieces = pieces.select(*names)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__released", T.BooleanType()), T.StructField("__gap", T.LongType())])

    def once(rows: DataFrame, n: int, base: int) -> DataFrame:
        parts = max(1, math.ceil(n / part))
        dealt = rows.repartition(parts)
        return stage(dealt.mapInArrow(lambda it: _pack_partition(it, parts, capacity, names, base), schema))

    with scratch() as s:
        rows = stage(pieces)
        n = rows.count()
        if not n:
            return s.keep(rows).select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        packed = s.keep(once(rows, n, 0))
        finished = []
        for base in count(1):
            released, bins, open_bins = packed.agg(F.count_if("__released"), F.count_if(F.col("offset") == 0), F.count_if(F.col("__released") & (F.col("offset") == 0))).first()
            if report:
                report({"round": base - 1, "sequences": bins, "released": released, "released_sequences": open_bins})
            if not released:
                break
            again = once(packed.where("__released").select(*names), released, base)
            new_bins = again.where("offset = 0").count()
            if new_bins >= open_bins:
                break
            finished.append(packed.where("not __released"))
            packed = s.keep(again)
    finished.append(packed)
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out.drop("__released", "__gap")
