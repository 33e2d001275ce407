"""SimHash near-dedup at a given similarity: wide fingerprints of sets of word shingles, bit-sliced comparison, exact check.

Documents with equal sets (by a 128-bit digest) are one numbered node, with a ``64 * WORDS``-bit SimHash of its set.  Two sets at similarity 0.8 differ in
some 15 % of the bits, ``RADIUS`` of ``128`` leaves out one such pair in 10^5.  At that radius pigeonhole blocks would have
3 bits, so the blocks inside which fingerprints are compared come from MinHash bands (``ROWS`` of ``BANDS * ROWS`` minima; a
pair at 0.8 shares none with probability ``(1 - 0.8 ** ROWS) ** BANDS``, 3e-6).  What the fingerprints let through is confirmed on
the exact sets, in two steps that never list the pairs inside a group:

1. every node with the nearest of its blocks' centres (another member in each block);
2. in blocks that still hold several groups, members of different groups by the bit-sliced counters of ``simhash``; what they
   let through is confirmed inside the block's task, and a block gives a spanning forest of its links.  Blocks of more than
   ``CAP`` members go in chunks, first each by itself with some members that all chunks hold: that joins a large group in
   rows that grow with its size alone.  Then members outside the block's largest group meet all others, every two chunks in a
   task of their own.  Tiles whose texts would take more than ``COPIES`` of each text go in several passes, so that the disk
   does not grow with the chunks met.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, cut, one_row_each, release_shuffles, row_digests, scratch, stage, text_bytes
from .simhash import _planes, near_masks

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
ALIKE = (4, 5)
WORDS, RADIUS = 2, 41
#: Fingerprints of more bits for pairs of larger sets, where a block has many pairs: 15 % of 1,024 bits and 5.3 deviations.
WIDE, WIDE_RADIUS, WIDE_SIZE = 16, 216, 64
BANDS, ROWS = 24, 4
CAP = 512
#: One in so many of ``CAP`` members is sent to all chunks of a block.
SHARED = 8
#: Texts that a pass over tiles sends, as copies of all texts.
COPIES = 2
_STEP = 512
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_A, _B = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_A |= np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def _folded(columns) -> np.ndarray:
    """One 64-bit hash of the values that stand at equal places."""
    h = np.uint64(0)
    for c in columns:
        h = h * _PRIME + c
        h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased; a shorter text is one shingle, a blank one has none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    return np.unique(_folded(h[i : len(h) - k + 1 + i] for i in range(k)))


def set_fingerprint(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` numbers of 64 bits: a bit is 1 if it is set in over half of the set's hashes, mixed anew for each number."""
    out = np.zeros(words, np.uint64)
    for i in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(s), 1 << 16):
            h = _mixed(s[at : at + (1 << 16)] * _PRIME + np.uint64(i))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key a band, from the minima of a set that is not empty."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(s), _STEP):
        np.minimum(low, (s[at : at + _STEP, None] * _A + _B).min(0), out=low)
    return _folded([np.arange(BANDS, dtype=np.uint64), *low.reshape(BANDS, ROWS).T])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


_FP = [f"f{i}" for i in range(WORDS)]
_OWN = ["node", "size", *_FP]
_SET = ["s1", "s2", *_OWN[1:]]


def _marks(rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``d1, d2, id`` plus a 128-bit digest of the set, the set's size, its fingerprint and its band keys."""
    src = rows.select(F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), F.col(doc_id).alias("id"), text_bytes(text).alias("__text"))
    schema = T.StructType([*src.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in _SET), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            own, keys = [], []
            for t in b.column(3):
                s = shingles(t.as_buffer().to_pybytes())
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                own.append((digest >> 64, digest & (1 << 64) - 1, len(s), *set_fingerprint(s).tolist()))
                keys.append(band_keys(s) if len(s) else np.zeros(0, np.uint64))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys])
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
            columns = np.array(own, np.uint64).reshape(-1, len(_SET)).view(np.int64).T
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in columns), lists], names=schema.names)

    return src.mapInArrow(run, schema)


def _squeezed(batches):
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([z.compress(t.as_buffer()) for t in b.column(2)], pa.binary())], names=["d1", "d2", "z"])


def _links(batches):
    """Of ``a, b`` and both compressed texts the pairs that are alike; the sets of a run of equal texts are made once."""
    d = zstandard.ZstdDecompressor()
    last: list[tuple] = [(None, None), (None, None)]

    def made(side: int, node: int, z) -> np.ndarray:
        if last[side][0] != node:
            last[side] = node, shingles(d.decompress(z.as_buffer()))
        return last[side][1]

    for b in batches:
        nodes = [b.column(i).to_pylist() for i in (0, 1)]
        ok = [alike(made(0, x, y), made(1, u, v)) for x, u, y, v in zip(*nodes, b.column(2), b.column(3), strict=True)]
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])


def _distance(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _FP[1:]), F.bit_count(F.col(f"{x}.f0").bitwiseXOR(F.col(f"{y}.f0"))))


def _fits(x: Column, y: Column) -> Column:
    """Sets of too different sizes cannot be alike."""
    return F.least(x, y) * ALIKE[1] >= F.greatest(x, y) * ALIKE[0]


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are alike; ``b`` is the side that many pairs share, so its text is joined last."""
    one, two = (texts.select(F.col("node").alias(c), F.col("z").alias(f"z{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "za", "zb")
    return cut(both.mapInArrow(_links, "a long, b long"))


def _block_links(root: np.ndarray, node: np.ndarray, size: np.ndarray, fps: np.ndarray, z: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Links between members of different roots that join all roots which near copies join."""
    n = len(node)
    planes, words = _planes(fps), -(-n // 64)
    step = max(1, (1 << 15) // words)
    above: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    d, links = zstandard.ZstdDecompressor(), []

    def find(r: int) -> int:
        while (up := above.get(r, r)) != r:
            r = up
        return r

    def made(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(d.decompress(z[i].as_buffer()))
        return sets[i]

    def wide(i: np.ndarray) -> np.ndarray:
        for j in () if known.all() else np.unique(i[~known[i]]).tolist():
            broad[j], known[j] = set_fingerprint(made(j), WIDE), True
        return broad[i]

    broad, known = np.zeros((n, WIDE), np.uint64), np.zeros(n, bool)
    for at in range(0, n, step):
        q = np.repeat(np.arange(at, min(n, at + step)), words)
        w = np.tile(np.arange(words), len(q) // words)
        live, mask = near_masks(planes, fps[q], w, RADIUS)
        r, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        x, y = q[live[r]], w[live[r]] * 64 + lane
        ok = y < x  # the padding lanes lie behind all members
        x, y = x[ok], y[ok]
        ok = (root[x] != root[y]) & (np.minimum(size[x], size[y]) * ALIKE[1] >= np.maximum(size[x], size[y]) * ALIKE[0])
        x, y = x[ok], y[ok]
        if len(x) > 4 * n:
            large = np.minimum(size[x], size[y]) >= WIDE_SIZE
            for a in range(0, len(x), 1 << 16):
                part = np.flatnonzero(large[a : a + (1 << 16)]) + a
                large[part] = np.bitwise_count(wide(x[part]) ^ wide(y[part])).sum(1, dtype=np.int64) > WIDE_RADIUS
            x, y = x[~large], y[~large]
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b and alike(made(i), made(j)):
                above[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[j])))
    return links


def _near_in_blocks(batches):
    """Rows ``key, root``, a node's columns and its compressed text, sorted by key: the links of each run of equal keys."""
    carry: pa.Table | None = None

    def links(t: pa.Table):
        key, root, node, size, *fp = (c.to_numpy() for c in t.columns[:-1])
        fps, texts = np.stack(fp, 1).view(np.uint64), t.column("z")
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            found = _block_links(root[lo:hi], node[lo:hi], size[lo:hi], fps[lo:hi], texts.slice(lo, hi - lo))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if carry is None else pa.concat_tables([carry, t]).combine_chunks()
        if not t.num_rows:
            continue
        key = t.column(0).to_numpy()
        cutoff = int(np.flatnonzero(key == key[-1])[0])
        yield from links(t.slice(0, cutoff))
        carry = t.slice(cutoff)
    if carry is not None:
        yield from links(carry)


def _rooted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links: the roots are joined by their components."""
    x, y = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    ends = links.join(x, "a", "left").join(y, "b", "left")
    roots = connected(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    new = cut(roots)
    moved = labels.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(new.join(labels, "node", "left_anti")))


def _rare_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, root`` and a node's columns: finer blocks, one for each rare shingle that several of the members share.

    Of a set with c shingles that other members have, the rarest ``c - ceil(0.8 size) + 1`` count; those that nobody else has
    come before all of them.
    """

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for node, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(d.decompress(z.as_buffer()))
                for at in range(0, len(s), 1 << 16):
                    some = s[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node)), pa.array(some)], names=["node", "g"])

    every = stage(members.select("node").join(texts, "node").mapInArrow(run, "node long, g long"))
    often = cut(every.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    shared = stage(every.join(often, "g"))
    room = shared.groupBy("node").agg(F.count("*").alias("c")).join(members.select("node", "size"), "node")
    room = cut(room.select("node", (F.col("c") - F.ceil(F.col("size") * ALIKE[0] / ALIKE[1]) + 1).alias("room")).where("room > 0"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "g"))
    picked = stage(shared.join(room, "node").withColumn("place", place).where("place <= room").select("g", "node"))
    same = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2))]
    blocks = cut(picked.groupBy("g").agg(*same).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("g").alias("g")).select("g"))
    return cut(picked.join(blocks, "g").join(members, "node").select(F.xxhash64(F.lit("rare"), "g").alias("key"), "root", *_OWN))


def _of_several(named: DataFrame) -> DataFrame:
    """``key, n`` of the blocks that hold several groups."""
    return cut(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"))


def _sides(named: DataFrame) -> DataFrame:
    """``key, top, own, rest`` of the blocks that hold several groups: the largest group, its members and those of all others."""
    groups = named.groupBy("key", "root").agg(F.count("*").alias("m"))
    top = [F.max_by("root", F.struct("m", "root")).alias("top"), F.max("m").alias("own"), (F.sum("m") - F.max("m")).alias("rest")]
    return cut(groups.groupBy("key").agg(*top).where("rest > 0"))


def _linked(nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``(node, root)`` of every node that has a near copy."""
    slots = nodes.select(*_OWN, F.explode("keys").alias("key"))
    # counts and centres are materialised before they are joined, so that a hot key can be split
    hit = cut(slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    shared = cut(slots.join(hit, "key"))
    centre = cut(shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("o"), *_OWN)).alias("c")).select("key", "c.*"))
    to_centre = shared.alias("x").join(centre.alias("y"), "key").where((F.col("x.node") != F.col("y.node")) & _fits(F.col("x.size"), F.col("y.size")))
    to_centre = to_centre.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _distance("x", "y").alias("d")).where(F.col("d") <= RADIUS)
    nearest = cut(to_centre.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")))
    wanted = cut(nodes.select("node", "d.d1", "d.d2").join(shared.select("node").distinct(), "node"))
    plain = rows.select(F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), text_bytes(text).alias("__text")).mapInArrow(_squeezed, "d1 long, d2 long, z binary")
    texts = cut(plain.join(wanted, ["d1", "d2"]).select("node", "z").dropDuplicates(["node"]))
    labels = cut(connected(_confirmed(nearest, texts)))
    named = cut(shared.join(labels, "node", "left").select("key", F.coalesce("root", "node").alias("root"), *_OWN))
    return _settled(named, labels, texts)


def _settled(named: DataFrame, labels: DataFrame, texts: DataFrame, finer: bool = True) -> DataFrame:
    """``labels`` after the links of all blocks ``key``, whose members have ``root`` and a node's columns."""
    mixed = _of_several(named)
    labels = _rooted(labels, _compared(*_by_themselves(named, mixed), texts))
    large = mixed.where(F.col("n") > CAP).select("key")
    if large.isEmpty():
        return labels
    left = named.join(large, "key").drop("root").join(labels, "node", "left").select("key", F.coalesce("root", "node").alias("root"), *_OWN)
    left = cut(left)
    sides = _sides(left)
    across = _across(left, sides)
    if not across[2]:
        return labels
    if finer:
        # finer blocks write a row for each shingle of their members, some times over; tiles one, with a text, for each chunk met
        members = cut(left.join(sides.select("key"), "key").select("root", *_OWN).distinct())
        if 2 * across[2] > (members.agg(F.sum("size")).first()[0] or 0):
            return _settled(_rare_blocks(members, texts), labels, texts, finer=False)
    return _rooted(labels, _compared(*across, texts))


def _chunk(n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(77), "key", "node"), n)


def _by_themselves(named: DataFrame, mixed: DataFrame) -> tuple[DataFrame, Column, int]:
    """The first tiles, their rows in proportion to the members: each chunk of a block, and in all chunks of a block the same few members."""
    chunks, some = F.ceil(F.col("n") / CAP), max(1, CAP // SHARED)
    everywhere = (chunks > 1) & (F.pmod(F.xxhash64(F.lit(78), "key", "node"), F.col("n")) < some)
    all_chunks = F.sequence(F.lit(0).cast("long"), chunks - 1)
    tile = F.transform(F.when(everywhere, all_chunks).otherwise(F.array(_chunk(chunks))), lambda j: F.xxhash64("key", j))
    sent = mixed.agg(F.sum(F.col("n") + some * (chunks - 1))).first()[0] or 0
    return named.join(mixed, "key"), tile, sent


def _across(named: DataFrame, sides: DataFrame) -> tuple[DataFrame, Column, int]:
    """The tiles of members of different groups: every chunk of those outside the largest group with every other chunk of the block."""
    rest, own = F.ceil(F.col("rest") / CAP), F.ceil(F.col("own") / CAP)
    outside = F.col("root") != F.col("top")
    rows = named.join(sides, "key").withColumn("c", F.when(outside, _chunk(rest)).otherwise(rest + _chunk(own)))
    met = F.filter(F.sequence(F.lit(0).cast("long"), rest - 1 + F.when(outside, own).otherwise(F.lit(0))), lambda j: j != F.col("c"))
    tile = F.transform(met, lambda j: F.xxhash64("key", F.least("c", j), F.greatest("c", j)))
    sent = sides.agg(F.sum(F.col("own") * rest + F.col("rest") * (rest + own - 1))).first()[0] or 0
    return rows, tile, sent


def _dealt(tiled: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of tiles with their texts, each tile's in one task."""
    return tiled.join(texts, "node").select("tile", "root", *_OWN, "z").repartition("tile").sortWithinPartitions("tile")


def _in_pass(tile: Column, i: int, passes: int) -> Column:
    """Those of the tiles that belong to pass ``i``."""
    return F.filter(tile, lambda t: F.pmod(t, F.lit(passes)) == i) if passes > 1 else tile


def _compared(blocks: DataFrame, tile: Column, sent: int, texts: DataFrame) -> DataFrame:
    """The links inside the tiles that ``tile`` names for each of the rows; ``sent`` rows go in passes of ``COPIES`` of all texts or so."""
    passes = max(1, -(-sent // (COPIES * max(1, texts.count()))))
    if passes > 1:
        blocks = cut(blocks)
    links = []
    for i in range(passes):  # a tile is whole in its pass; what other passes send is not written out
        tiled = blocks.select(F.explode(_in_pass(tile, i, passes)).alias("tile"), "root", *_OWN)
        links.append(cut(_dealt(tiled, texts).mapInArrow(_near_in_blocks, "a long, b long").distinct()))
        if passes > 1:
            release_shuffles(texts.sparkSession)
    return reduce(DataFrame.unionByName, links)


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies; a row without a near copy always stays.

    Groups are the connected components of the similarity, blank and null texts being one group.  The row with the smallest
    id stays, a null id counting as the largest, and of equal ids the one with the smallest digest of all columns.  All columns
    stay, whatever their names; an empty table gives an empty result.
    """
    with scratch() as s:
        rows = row_digests(docs)
        marks = cut(_marks(rows, text, doc_id))
        sets = marks.groupBy("s1", "s2").agg(F.min(F.struct("d1", "d2")).alias("d"), *(F.first(c).alias(c) for c in (*_SET[2:], "keys")))
        nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()))
        marked = marks.select("d1", "d2", "id", "s1", "s2").join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).select("d1", "d2", "id", "node")
        out, read = one_row_each(rows, marked, _linked(nodes, rows, text))
        s.keep(read)
    return out
