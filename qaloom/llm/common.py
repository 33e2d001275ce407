"""What the operators of this subpackage share: shared-folder staging, row identity and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, shared_folder

#: The word separator of the text contracts: ASCII space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """What ``cut`` and ``stage`` have written inside a ``scratch`` block: folder -> how to delete it."""

    def __init__(self):
        self.written: dict[str, Callable[[], None]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a result of ``cut`` or ``stage``, outlives the block and belongs to the next outer one, if there is one."""
        at = _open.index(self)
        for path in _paths(df):
            gone = self.written.pop(path, None)
            if gone and at:
                _open[at - 1].written[path] = gone
        return df

    def delete(self) -> None:
        for gone in self.written.values():
            gone()
        self.written.clear()


_open: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Deletes at its end what ``cut`` and ``stage`` wrote inside, but for what is kept."""
    s = Scratch()
    _open.append(s)
    try:
        yield s
    finally:
        s.delete()
        _open.remove(s)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result is cut before all else that it wrote is deleted; for operators with narrow results."""

    @wraps(f)
    def run(*args, **kw) -> DataFrame:
        with scratch() as s:
            return s.keep(cut(f(*args, **kw)))

    return run


def _paths(df: DataFrame) -> list[str]:
    return df.__dict__.get("_qaloom_paths", [])


def written(df: DataFrame, path: str, gone: Callable[[], None] | None = None) -> DataFrame:
    """Note that ``df`` reads the folder ``path``, which the innermost open block deletes."""
    df.__dict__["_qaloom_paths"] = [path]
    if _open:
        _open[-1].written[path] = gone or (lambda: delete_folder(df.sparkSession, path))
    return df


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` or ``stage`` wrote for ``df``; any other table stays."""
    for path in _paths(df):
        for s in _open:
            s.written.pop(path, None)
        delete_folder(df.sparkSession, path)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage (for narrow tables).

    ``parts`` bounds the files: small results of many shuffle partitions then do not become as many tiny files.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = (df.coalesce(parts) if parts else df).checkpoint(eager=True)
    # a checkpoint inherits its plan's size estimate, a product over all joins: carried from cut to cut it gets millions of
    # digits long.  Read as a plain source, the table has the default estimate, and adaptive execution sees real sizes.
    rdd = out._jdf.queryExecution().analyzed().rdd()
    plain = spark._jsparkSession.internalCreateDataFrame(rdd, out._jdf.schema(), False)
    return written(DataFrame(plain, spark), rdd.getCheckpointFile().get())


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def parts_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Partitions for ``size`` bytes at ``each`` bytes, two a core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // each))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (for wide or large tables)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    if _paths(df):  # staged or cut already
        return df
    df.write.parquet(path)
    return written(spark.read.schema(schema).parquet(path), path)


def clear_of(docs: DataFrame, keep: list[str], own: list[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` and ``keep`` with kept columns renamed that an output column's name clashes with: underscores go behind them."""
    taken, out = {*own, *keep}, []
    for c in keep:
        new = c
        while new in own or (new != c and new in taken):
            new += "_"
        taken.add(new)
        out.append(new)
    return docs.select("*", *[F.col(c).alias(n) for c, n in zip(keep, out, strict=True) if n != c]), out


def text_bytes(col: str | Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``: a split that every engine can recompute."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has long columns ``a`` and ``b``; the result has one row ``(node, root)`` for every node of an edge,
    ``root`` being the smallest node of its component.  All state stays distributed: a round is two grouped minima
    (combined before the shuffle) and two joins, and is checkpointed.  The round's edge set is compared with the last
    one by count and hash sum; equality ends the loop.  Nulls in an edge are ignored; no edges give an empty result.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)

    def mark(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # the minima are materialised before they are joined, so that both join sides are plain shuffles and a hub can be split
        with scratch() as s:
            sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = cut(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = cut(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low2 = cut(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = s.keep(cut(small.union(low2.select("u", F.col("m").alias("v"))).distinct()))
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def row_digests(docs: DataFrame) -> DataFrame:
    """``docs`` plus a 128-bit digest ``__d1, __d2`` of all columns: a key that holds wherever a row is read again."""
    whole = [x for c in docs.columns for x in (F.isnull(c), F.col(c))]
    return docs.withColumns({f"__d{s}": F.xxhash64(F.lit(s), *whole) for s in (1, 2)})


def one_row_each(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each group of rows the one with the smallest ``(id, digest)``; a null id counts as the largest.

    ``docs`` carries digests, ``marked`` has ``(d1, d2, id, node)`` for each of its rows and ``roots`` ``(node, root)`` for
    the nodes that have company.  Of rows equal in all columns one stays.  The second result is the cut table that the first
    still reads.
    """
    rows = marked.groupBy("node", "d1", "d2").agg(F.first("id").alias("id"), F.count("*").alias("n"))
    rows = cut(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    # materialised, so that a large group can be split in the join
    first = cut(rows.groupBy("root").agg(F.min(F.struct(F.isnull("id"), "id", "d1", "d2")).alias("f")).select("root", "f.d1", "f.d2"))
    key = ["__d1", "__d2"]
    other = (F.col("x.d1") != F.col("y.d1")) | (F.col("x.d2") != F.col("y.d2"))
    paired = rows.alias("x").join(first.alias("y"), "root").select(F.col("x.d1").alias("__d1"), F.col("x.d2").alias("__d2"), "n", other.alias("gone"))
    paired = cut(paired.where("gone or n > 1"))
    kept = docs.join(paired.where("gone").select(*key), key, "left_anti")
    twice = paired.where("not gone and n > 1").select(*key)
    if not twice.isEmpty():
        once = kept.join(twice, key, "left_semi").dropDuplicates(key)
        kept = kept.join(twice, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return kept.drop(*key), paired
