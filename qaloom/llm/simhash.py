"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

Fingerprints are built per document in Arrow batches.  Linking works on *distinct* fingerprints only, so a group of a
million equal texts is one node.  Candidates come from the pigeonhole rule: two fingerprints at most ``radius`` bits
apart agree in at least one of ``radius + 1`` blocks.  A bucket of equal block values that is larger than
``BUCKET_CAP`` is split again by the same rule on its remaining bits, and what is still too large is compared chunk by
chunk, so no task holds more than two chunks and no link is lost.  Inside a bucket the fingerprints are stored as 64 vertical bit
planes; a query's distances to 64 fingerprints at a time are counted with carry-save adders, and a word of 64 is
abandoned as soon as all its lanes exceed the radius.  A bucket emits a spanning forest of its links, never all pairs.

``simhash_sets`` has the form for sets of word shingles and a similarity, on wider fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, connected, cut, text_bytes, tidy

RADIUS = 4
SHINGLE = 4
BUCKET_CAP = 4096
_STEP = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of one text: lower-cased ASCII letters, word shingles with repeats, XXH64 with seed 42."""
    w = text.lower().split()
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < words:
        return h(join(w), 42)
    n, ones = len(w) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = w[at : min(at + _STEP, n) + words - 1]
        got = np.array([h(join(t), 42) for t in zip(*(part[i:] for i in range(words)))], np.uint64)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``) plus the signed 64-bit fingerprint.  A null or blank text has fingerprint 0."""
    docs, keep = clear_of(docs, keep or ["doc_id"], [out])
    src = docs.select(*keep, text_bytes(text).alias("__text"))
    schema = src.select(*keep, F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(len(keep)).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp.view(np.int64))], names=[*keep, out])

    return src.mapInArrow(run, schema)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical storage: row p holds bit p of 64 fingerprints per word; a fingerprint is a number or a row of numbers."""
    fps = fps.reshape(len(fps), -1)
    pad = np.zeros((-len(fps) % 64, fps.shape[1]), np.uint64)
    bits = np.unpackbits(np.concatenate([fps, pad]).view(np.uint8), axis=1, bitorder="little")
    lanes = np.ascontiguousarray(bits.reshape(-1, 64, bits.shape[1]).transpose(2, 0, 1))
    return np.ascontiguousarray(np.packbits(lanes, axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def _add(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three bit planes: (sum plane, carry plane)."""
    u = a ^ x
    return u ^ y, a & x | u & y


def near_masks(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each (query fingerprint, word of 64 fingerprints): the lanes within ``radius`` bits, as a mask.

    Returns the indices of the surviving (query, word) pairs and their masks.  A fingerprint has 64 bits or, as a row of
    ``query``, several words of 64; ``planes`` has a row for each bit.  Counters are bit-sliced: ``c[k]`` holds bit k of 64
    distances.  Eight planes at a time pass a tree of carry-save adders; what leaves it, worth eight, ripples into the higher
    counters.  They are preset so that the carry out of the top one marks a distance over the radius.
    """
    query = query.reshape(len(query), -1)
    levels = max(3, int(radius + 1).bit_length())
    start = (1 << levels) - (radius + 1)  # overflows exactly at radius + 1 differing bits
    live = np.arange(len(query))
    q, w = query, word
    full = ~np.uint64(0)
    c = [np.full(len(q), full if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    dead = np.zeros(len(q), np.uint64)
    for at in range(0, len(planes), 8):
        bits = q[:, at // 64]
        x = [planes[p, w] ^ (np.uint64(0) - (bits >> np.uint64(p % 64) & np.uint64(1))) for p in range(at, at + 8)]
        fours = []
        for i in (0, 4):
            c[0], two = _add(c[0], x[i], x[i + 1])
            c[0], other = _add(c[0], x[i + 2], x[i + 3])
            c[1], four = _add(c[1], two, other)
            fours.append(four)
        c[2], over = _add(c[2], *fours)
        for k in range(3, levels):
            c[k], over = c[k] ^ over, c[k] & over
        dead |= over
        if at >= 8:
            keep = np.flatnonzero(dead != full)
            if len(keep) < len(live):
                live, q, w, dead = live[keep], q[keep], w[keep], dead[keep]
                c = [y[keep] for y in c]
            if not len(live):
                break
    return live, ~dead


def bucket_forest(fps: np.ndarray, bounds: np.ndarray, radius: int = RADIUS, step: int = 1 << 15) -> np.ndarray:
    """Spanning-forest edges (pairs of positions) of the links inside each bucket ``fps[bounds[i]:bounds[i + 1]]``.

    Buckets are padded to whole words, so that one run of plane operations serves many small buckets at once.
    """
    root = np.arange(len(fps))
    sizes = np.diff(bounds)
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)])
    padded = np.zeros(first_word[-1] * 64, np.uint64)
    lane = np.repeat(first_word[:-1] * 64 - bounds[:-1], sizes) + np.arange(len(fps))
    padded[lane] = fps
    back = np.full(len(padded), -1)
    back[lane] = np.arange(len(fps))
    planes = _planes(padded)
    per_query = np.repeat(words, sizes)
    start = np.repeat(first_word[:-1], sizes)
    ends = np.cumsum(per_query)
    edges = []

    def find(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(r := root[x], x):
            x = r
        return x

    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        n = per_query[lo:hi]
        qi = np.repeat(np.arange(lo, hi), n)
        wi = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[qi]
        live, mask = near_masks(planes, fps[qi], wi, radius)
        if len(live):
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane_no = np.nonzero(bits)
            a, b = qi[live[r]], back[wi[live[r]] * 64 + lane_no]
            ok = (b >= 0) & (b < a)
            a, b = a[ok], b[ok]
            while len(a):  # hook larger roots under smaller ones until every link is inside one tree
                ra, rb = find(a), find(b)
                keep = ra != rb
                if not keep.any():
                    break
                a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
                up, down = np.maximum(ra, rb), np.minimum(ra, rb)
                order = np.lexsort((down, up))
                up, down, pick = up[order], down[order], order
                first = np.concatenate([[True], up[1:] != up[:-1]])
                root[up[first]] = down[first]
                edges.append(np.stack([a[pick[first]], b[pick[first]]], 1))
        lo = hi
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _forest_batches(batches, radius: int):
    """Rows (gkey, fp) sorted by gkey; a group may span Arrow batches and is carried over."""
    carry_k, carry_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys, fps):
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        f = fps.view(np.uint64)
        e = bucket_forest(f, bounds, radius)
        return pa.RecordBatch.from_arrays([pa.array(fps[e[:, 0]]), pa.array(fps[e[:, 1]])], names=["a", "b"])

    for b in batches:
        k = np.concatenate([carry_k, b.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([carry_f, b.column(1).to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        cutoff = int(np.searchsorted(k, k[-1], "left"))
        carry_k, carry_f = k[cutoff:], f[cutoff:]
        if cutoff:
            yield out(k[:cutoff], f[:cutoff])
    if len(carry_k):
        yield out(carry_k, carry_f)


def _block_keys(bits: list[int], parts: int, prefix) -> F.Column:
    """An array of one key per block, a block being every ``parts``-th of the given bit positions' contiguous runs."""
    keys, at = [], 0
    for i in range(parts):
        n = len(bits) // parts + (i < len(bits) % parts)
        lo, at = bits[at], at + n
        mask = (1 << n) - 1
        keys.append(F.xxhash64(prefix, F.lit(i), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def candidate_groups(nodes: DataFrame, radius: int = RADIUS, cap: int = BUCKET_CAP) -> DataFrame:
    """Rows ``(gkey, fp)``: any two fingerprints within ``radius`` share a ``gkey``, and no group exceeds twice ``cap`` or so."""
    parts = radius + 1
    width = [64 // parts + (i < 64 % parts) for i in range(parts)]
    offset = [sum(width[:i]) for i in range(parts)]
    level1 = nodes.select("fp", F.posexplode(_block_keys(list(range(64)), parts, F.lit(1))).alias("blk", "gkey"))
    done, level = None, level1
    for depth in (1, 2):
        # materialised, so that the join has plain shuffles on both sides and a large bucket can be split
        sizes = cut(level.groupBy("gkey").agg(F.count("*").alias("n")).where(F.col("n") > cap))
        marked = level.join(sizes, "gkey", "left")
        fits = marked.where("n is null").select("gkey", "fp")
        done = fits if done is None else done.unionByName(fits)
        over = marked.where("n is not null")
        if depth == 2:
            break
        again = None
        for blk in range(parts):  # the same rule on the bits outside the shared block
            rest = [i for i in range(64) if not offset[blk] <= i < offset[blk] + width[blk]]
            # runs that straddle the removed block are cut there, so a key reads contiguous bits of either side
            lowpart = [i for i in rest if i < offset[blk]]
            rotated = F.shiftrightunsigned("fp", offset[blk] + width[blk])
            packed = rotated
            if lowpart:
                packed = rotated.bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(F.lit((1 << len(lowpart)) - 1)), 64 - offset[blk] - width[blk]))
            sub = over.where(F.col("blk") == blk).select(F.col("fp").alias("orig"), "gkey", packed.alias("fp"))
            sub = sub.select(F.col("orig").alias("fp"), F.explode(_block_keys(list(range(len(rest))), parts, F.col("gkey"))).alias("gkey"))
            again = sub if again is None else again.unionByName(sub)
        level = cut(again)
    # adversarial rest: triangular comparison of hash chunks, each task sees two chunks
    chunks = F.ceil(F.col("n") / cap)
    mine = F.pmod(F.xxhash64(F.lit(77), "fp"), chunks)
    tri = over.withColumn("c", mine).select(
        F.explode(F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64(F.lit(3), "gkey", F.least("c", j), F.greatest("c", j)))).alias("gkey"), "fp"
    )
    return done.unionByName(tri)


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, cap: int = BUCKET_CAP) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits."""
    groups = candidate_groups(nodes, radius, cap)
    dealt = groups.repartition("gkey").sortWithinPartitions("gkey")
    return dealt.mapInArrow(lambda it: _forest_batches(it, radius), "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per input row.

    Null or blank texts have fingerprint zero and link like any other.  Rows with a null id keep their row; the component
    id is the smallest non-null id of the component (null if there is none).  Repeated rows stay repeated.  An empty table
    gives an empty result.  Extra columns are not read.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = cut(add_fingerprint(src))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = connected(link_fingerprints(nodes.select("fp"), radius))
    rooted = cut(nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # materialised, so that the join below has plain shuffles on both sides and a large component can be split
    comp = cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    labels = cut(rooted.select("fp", "root").join(comp, "root").select("fp", "component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
