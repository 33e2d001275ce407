"""Prefix trie of conversations: every distinct beginning is a node with counts over the conversations that share it.

A conversation is its turns' 128-bit labels and word counts; a node's key is the digest of the labels from the root on.  Equal
conversations are grouped first, so that copies are one path with a count.  Nodes with more than ``CAP`` different paths below them are
the heavy upper levels; every other child of a heavy node is the root of a whole subtree, and subtrees are dealt to prefix shards of
about ``CAP`` paths.  A shard is one succinct trie in level order: a LOUDS bit vector (a one for each child, then a zero), an array
of labels, and parents found from the bits; rollups run over the levels backwards with ``add.at`` and ``minimum.at``.  The heavy
levels are merged apart, from one row a subtree, by sums over each subtree's heavy ancestors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, scratch, stage

#: Different conversations below a node that is not split further, and of a shard.
CAP = 5_000
#: Conversation ids are hashed in pieces of so many.
PIECE = 10_000
ROOT = "0" * 32

_FIELDS = [("key", T.StringType()), ("parent", T.StringType()), ("depth", T.LongType()), ("conv_id", T.LongType()), ("parent_conv_id", T.LongType()), ("n_convs", T.LongType()), ("n_children", T.LongType()), ("n_leaves", T.LongType()), ("saved_tokens", T.LongType())]
NODES = T.StructType([T.StructField(n, t) for n, t in _FIELDS])


def rebuilt(conversations: DataFrame, shared: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id`` and its turns after rebuilding: the first h turns of conversation ``c - c % shared``, then its own after h.

    h is crc32 of the id in decimal, modulo ``heads``.  Turns go by number, null first, equal numbers by their label.  A turn is
    ``(label, words)``, the label being the md5 of role and text, which count as empty where they are null.  Rows without an id
    belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    # null sorts first inside a struct
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", label.alias("label"), words.alias("words")).alias("t"))
    own = cut(rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["label"].alias("label"), x["words"].alias("words"))).alias("own")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    head = own.where(F.col("conv_id") % shared == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads).alias("head"))
    both = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % shared).join(head, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("filter(own, x -> false)"))
    return both.select("conv_id", F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


def _keyed(batches):
    """``conv_id, key, keys, words``: the keys of all nodes of a conversation, the last one being its own."""
    for b in batches:
        keys, words, ends = [], [], []
        for turns in b.column(1).to_pylist():
            k, mine = ROOT, []
            for t in turns:
                k = xxhash.xxh3_128_hexdigest(k + t["label"])
                mine.append(k)
            keys.append(mine)
            words.append([t["words"] for t in turns])
            ends.append(k)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.string()), pa.array(keys, pa.list_(pa.string())), pa.array(words, pa.list_(pa.int64()))], names=["conv_id", "key", "keys", "words"])


def louds(child_counts: np.ndarray) -> np.ndarray:
    """The bits of a level-order trie: for each node a one for each child, then a zero; before them ``10`` for the super-root."""
    ends = np.cumsum(child_counts + 1)
    bits = np.ones(2 + int(ends[-1]) if len(ends) else 2, bool)
    bits[1] = False
    bits[1 + ends] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of every node: the zeros before its one, less one; -1 for the first node, whose parent is the super-root."""
    return (np.cumsum(~bits)[bits] - 1).astype(np.int64)


def _levels(paths: list[np.ndarray], labels_of: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(child counts, label numbers, depths, node of each path's end)`` in level order, below one super node 0."""
    length = np.array([len(p) for p in paths])
    flat, at = np.concatenate(paths), np.concatenate([[0], np.cumsum(length)[:-1]])
    node = np.zeros(len(paths), np.int64)
    counts, labels, depths = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    first, total, d = 0, 1, 0
    while (alive := np.flatnonzero(length > d)).size:
        pair = node[alive] * len(labels_of) + flat[at[alive] + d]
        new, inverse = np.unique(pair, return_inverse=True)  # in the order of parents: level order
        np.add.at(counts[-1], new // len(labels_of) - first, 1)
        node[alive] = total + inverse
        counts.append(np.zeros(len(new), np.int64))
        labels.append(new % len(labels_of))
        depths.append(np.full(len(new), d + 1))
        first, total, d = total, total + len(new), d + 1
    return np.concatenate(counts), np.concatenate(labels), np.concatenate(depths), node


def _shard(t: pa.Table) -> pa.Table:
    """The nodes of a shard's subtrees; its roots keep the key of their heavy parent and get no ``parent_conv_id`` here."""
    columns = {c: t.column(c).to_pylist() for c in ("keys", "words", "skip", "least", "n", "above")}
    names = sorted({k for keys, skip in zip(columns["keys"], columns["skip"], strict=True) for k in keys[skip:]})
    number = {k: i for i, k in enumerate(names)}
    paths = [np.array([number[k] for k in keys[skip:]], np.int64) for keys, skip in zip(columns["keys"], columns["skip"], strict=True)]
    counts, label, depth, end = _levels(paths, names)
    bits = louds(counts)
    up = parents(bits)
    size, top = len(up), counts[0]
    words = np.zeros(len(names), np.int64)
    for p, w, skip in zip(paths, columns["words"], columns["skip"], strict=True):
        words[p] = w[skip:]
    n, leaves, least = np.zeros(size, np.int64), (counts == 0).astype(np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(n, end, np.array(columns["n"], np.int64))
    np.minimum.at(least, end, np.array(columns["least"], np.int64))
    edges = [*np.flatnonzero(np.diff(depth, prepend=-1)), size]
    levels = list(zip(edges[1:-1], edges[2:], strict=True))[::-1]
    for a, z in levels:
        np.add.at(n, up[a:z], n[a:z])
        np.minimum.at(least, up[a:z], least[a:z])
    saved = (n - 1) * words[label]
    for a, z in levels:
        np.add.at(leaves, up[a:z], leaves[a:z])
        np.add.at(saved, up[a:z], saved[a:z])
    skip, above = {}, {}
    for keys, s, x in zip(columns["keys"], columns["skip"], columns["above"], strict=True):
        skip[keys[s]], above[keys[s]] = s, x
    base, own = np.zeros(size, np.int64), label[1 : 1 + top]
    base[1 : 1 + top] = [skip[names[i]] for i in own]
    for a, z in levels[::-1][1:]:
        base[a:z] = base[up[a:z]]
    key = [names[i] for i in label[1:]]
    parent = [above[k] for k in key[:top]] + [names[i] for i in label[up[1 + top :]]]
    mother = pa.array(np.where(up[1:] > 0, least[up[1:]], 0), mask=up[1:] == 0)
    numbers = (base + depth)[1:], least[1:], n[1:], counts[1:], leaves[1:], saved[1:]
    d, a, *rest = (pa.array(x) for x in numbers)
    return pa.table([pa.array(key, pa.string()), pa.array(parent, pa.string()), d, a, mother, *rest], names=NODES.names)


def _id_pieces(batches, size: int):
    """Of ``key, conv_id`` in order the ids of each key in decimal, joined by commas, some ``size`` a row."""
    held, key = [], None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["key", "first", "ids"])

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (k != key or len(held) >= size):
                yield row()
                held = []
            key = k
            held.append(c)
    if held:
        yield row()


def _hashed(batches):
    """The SHA-256 of each key's pieces, in order, joined by commas."""
    key, h = None, None
    done: tuple[list, list] = ([], [])
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k == key:
                h.update(b",")
            else:
                if h is not None:
                    done[0].append(key)
                    done[1].append(h.hexdigest())
                key, h = k, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], names=["key", "ends_sha256"])
        done = ([], [])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``key, ends_sha256``: the hash of the ascending ids of the conversations that end at a node.

    Ids are sorted over all partitions and joined to pieces there; the hash itself, which has to see them in order, streams over pieces.
    """
    pieces = convs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda it: _id_pieces(it, piece), "key string, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, ends_sha256 string")


def prefix_trie(convs: DataFrame, cap: int = CAP, piece: int = PIECE) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` has a ``conv_id`` (each once) and its ``turns``, structs of ``label`` and ``words``; one without turns ends at the root.
    ``conv_id`` of a node is its smallest member, ``saved_tokens`` what a cache of shared beginnings saves in its subtree, in words.
    A conversation's labels have to fit into a task (48 bytes a turn).  An empty table gives an empty result.
    """
    with scratch() as s:
        schema = "conv_id long, key string, keys array<string>, words array<long>"
        keyed = stage(convs.select("conv_id", "turns").mapInArrow(_keyed, schema))
        paths = stage(keyed.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words")))
        # heavy nodes, the root always being one, and the last heavy node of each path
        steps = paths.select("key", F.explode("keys").alias("node"))
        heavy = cut(steps.groupBy("node").agg(F.count("*").alias("below")).where(F.col("below") > cap).select("node"))
        deep = cut(steps.join(heavy, "node").groupBy("key").agg(F.count("*").cast("int").alias("skip")))
        split = stage(paths.join(deep, "key", "left").withColumn("skip", F.coalesce("skip", F.lit(0))))
        above = F.when(F.col("skip") > 0, F.element_at("keys", F.greatest("skip", F.lit(1)))).otherwise(F.lit(ROOT))
        shards = max(1, -(-paths.count() // cap))
        below = split.where(F.size("keys") > F.col("skip")).withColumn("above", above)
        below = below.withColumn("root", F.element_at("keys", F.col("skip") + 1)).withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
        lower = stage(below.groupBy("shard").applyInArrow(_shard, NODES))

        upper = cut(_upper(split, lower, above))
        roots = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("mother"))
        known, open_ = lower.where("parent_conv_id is not null"), lower.where("parent_conv_id is null")
        named = open_.unionByName(upper).drop("parent_conv_id").join(roots, "parent", "left").withColumnRenamed("mother", "parent_conv_id")
        nodes = known.unionByName(named)
        none = F.lit(hashlib.sha256().hexdigest())
        out = nodes.join(ends(keyed.select("key", "conv_id"), piece), "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
        return s.keep(cut(out))


def _upper(split: DataFrame, lower: DataFrame, above: Column) -> DataFrame:
    """The heavy nodes in the form of ``NODES``, from their subtrees' roots and the paths that end at one of them."""
    tops = lower.where("parent_conv_id is null").select("key", "parent", F.col("conv_id").alias("least"), "n_convs", "n_leaves", "saved_tokens")
    # the heavy line of a node: keys and words from the root down to the last heavy node of any path through it
    line = split.select(above.alias("at"), F.slice("keys", F.lit(1), F.col("skip")).alias("keys"), F.slice("words", F.lit(1), F.col("skip")).alias("words"))
    lines = cut(line.groupBy("at").agg(F.first("keys").alias("keys"), F.first("words").alias("words")))
    ending = split.where(F.size("keys") == F.col("skip")).select(above.alias("parent"), "least", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(0).cast("long").alias("kids"))
    parts = tops.drop("key").withColumn("kids", F.lit(1).cast("long")).unionByName(ending)
    # first what each heavy node has directly below it, then every heavy node's share goes to the heavy nodes above it
    total = [F.min("least").alias("least"), *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens", "kids"))]
    direct = cut(parts.groupBy(F.col("parent").alias("at")).agg(*total))
    spread = direct.join(lines, "at").select("least", "n_convs", "n_leaves", "saved_tokens", F.posexplode(F.concat(F.array(F.lit(ROOT)), "keys")).alias("depth", "key"), "words", "keys")
    word = F.when(F.col("depth") > 0, F.element_at("words", F.greatest("depth", F.lit(1)))).otherwise(F.lit(0))
    up = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.element_at("keys", F.greatest(F.col("depth") - 1, F.lit(1))))
    spread = spread.select("key", "depth", word.alias("words"), up.alias("parent"), "least", "n_convs", "n_leaves", "saved_tokens")
    nodes = cut(spread.groupBy("key").agg(F.first("depth").cast("long").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.min("least").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens"))))
    # a heavy node's own saving counts for itself and all heavy nodes above it; so does its being a leaf: summed along one line of each
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("heavy_kids"))
    own = nodes.join(direct.select(F.col("at").alias("key"), "kids"), "key", "left").join(kids.withColumnRenamed("parent", "key"), "key", "left")
    own = own.withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.coalesce("heavy_kids", F.lit(0)))
    own = cut(own.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    on_line = lines.select("at", F.posexplode(F.concat(F.array(F.lit(ROOT)), "keys")).alias("depth", "key"))
    owner = on_line.groupBy("key").agg(F.min("at").alias("owner"))
    there = on_line.join(own.select("key", "own_saved", "leaf"), "key").join(owner, "key")
    from_below = Window.partitionBy("at").orderBy(F.desc("depth"))  # a line is as long as a conversation at most
    mine = lambda c: F.sum(F.when(F.col("at") == F.col("owner"), F.col(c)).otherwise(0)).over(from_below)
    more = there.select("key", mine("own_saved").alias("own_saved"), mine("leaf").alias("leaf")).groupBy("key").agg(F.sum("own_saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    out = own.join(more, "key")
    return out.select("key", "parent", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"))


def oracle(table: str = "conversations", shared: int = 20, heads: int = 4) -> str:
    """The trie in DuckDB SQL, every conversation at every node of its path; for small tables."""
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT for x in string_split(c::VARCHAR, '')]), lambda a, x: " + "{})"
    step = "xor(a, x)"
    for _ in range(8):
        step = f"list_reduce([{step}, 0::UBIGINT], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)"
    h = f"(xor({crc.format(step)}, 4294967295::UBIGINT) % {heads})::INT"
    return f"""
WITH t AS (SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS label FROM {table} WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY turn NULLS FIRST, label) AS own FROM t GROUP BY c),
sized AS (SELECT c, own, {h} AS h FROM own),
path AS (SELECT a.c, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS p FROM sized a LEFT JOIN own b ON b.c = a.c - a.c % {shared}),
steps AS (SELECT c, len(p) AS size, unnest(range(0, len(p) + 1)) AS d, p FROM path),
member AS (SELECT c, size, d, md5(p[1:d]::VARCHAR) AS key, CASE WHEN d > 0 THEN md5(p[1:d - 1]::VARCHAR) END AS parent, CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].text, '{WORD}')) ELSE 0 END AS words FROM steps),
node AS (SELECT d, key, min(parent) AS parent, min(c) AS conv_id, count(*) AS n, min(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM member GROUP BY d, key),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, key)),
line AS (SELECT DISTINCT a.d, a.key, b.d AS up_d, b.key AS up_key FROM member a JOIN member b ON a.c = b.c AND b.d <= a.d),
rolled AS (SELECT up_d AS d, up_key AS key, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * words) AS saved FROM line JOIN full_node USING (d, key) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, m.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, r.leaves AS n_leaves, r.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN rolled r USING (d, key) LEFT JOIN node m ON m.d = f.d - 1 AND m.key = f.parent
"""
