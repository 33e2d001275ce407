"""Resumable processing: anti-joins on keys, appended tables, and file streams with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import normalize
from ..operators.align import with_occurrence


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_occurrences(todo: DataFrame, done: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same where keys repeat: as many occurrences count as done as there are results."""
    n = done.groupBy(*keys).agg(F.count("*").alias("__n"))
    ranked = with_occurrence(todo, keys, [order], "__k")
    return ranked.join(n, keys, "left").where("__k >= coalesce(__n, 0)").drop("__k", "__n")


def pending_positions(todo: DataFrame, done: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows behind the prefix that is done, by place and not by count."""
    return todo.join(done.select(pos), pos, "left_anti")


def append_results(existing: DataFrame, fresh: DataFrame, pos: str = "pos") -> DataFrame:
    """Bag union with the fresh rows' places behind the existing ones."""
    last = existing.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("__last"))
    moved = fresh.crossJoin(F.broadcast(last)).withColumn(pos, F.col(pos) + F.col("__last")).drop("__last")
    return existing.unionByName(moved)


def window_rows(rows: DataFrame, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows by place in ``order`` (a 0-based dense place column): from ``skip`` on, ``limit`` at most."""
    out = rows.where(F.col(order) >= skip)
    return out.where(F.col(order) < skip + limit) if limit is not None else out


def place_rows(rows: DataFrame, key: str, out: str = "place", buckets: int = 64) -> DataFrame:
    """Dense 0-based places in order of a numeric ``key`` without a global window: buckets, their counts, and ranks inside them.

    The buckets' bounds are quantiles of the data, so a bucket holds about an equal share of the rows whatever their keys
    are; there are at least as many as shuffle partitions.  Null keys come first.  Ties are ranked by a digest of all columns.
    """
    columns = rows.columns
    buckets = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("b")).first()["b"] or []
    dealt = rows.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x < F.col(key))) if bounds else F.lit(0))
    counts = dealt.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__b").orderBy(key, F.xxhash64(*columns))))
    return ranked.join(F.broadcast(before), "__b").withColumn(out, (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__b", "__k", "__before")


def stream_jsonl(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def process_available(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process every file that has come since the last call, once each, into Parquet at ``out``; ends when none is left.

    Progress lies in ``checkpoint``: a rerun after a failure neither loses nor repeats rows.
    """
    q = work(source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()


def process_batches(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """The same with a sink of its own a micro-batch (``sink(rows, batch id)``; make it idempotent by the id)."""
    q = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None, value: str = "value") -> DataFrame:
    """Extension: counts and sums a window of event time; with ``late``, a watermark for streams."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Extension: sessions that end after a gap without events."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Extension: the first event of each key."""
    return events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(*order)).alias("e")).select(*keys, "e.*")


def stateful(spark: SparkSession) -> SparkSession:
    """Keyed state with a time limit needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Matcher(StatefulProcessor):
    """Per key the rows of either side that still wait for their partner, as (place, value), oldest first.

    The k-th row of one side meets the k-th of the other, whichever comes first; so one of the two lists is always empty.
    """

    def __init__(self, keys: list[str], limit_ms: int | None):
        self.keys, self.limit_ms = keys, limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = {s: handle.getListState(s, "pos long, value string") for s in ("left", "right")}

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        lists = {s: [tuple(x) for x in self.waiting[s].get()] for s in self.waiting}
        for frame in rows:
            for side, pos, value in zip(frame["side"], frame["pos"], frame["value"], strict=True):
                lists[side].append((int(pos), value))
        for s in lists:
            lists[s].sort(key=lambda x: x[0])
        n = min(map(len, lists.values()))
        for s, state in self.waiting.items():
            state.clear()
            if lists[s][n:]:
                state.put(lists[s][n:])
        if self.limit_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if len(lists["left"]) > n:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield self._frame(key, [(p, v) for (p, _), (_, v) in zip(lists["left"][:n], lists["right"][:n], strict=True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """Left rows that have waited too long go without a partner."""
        late = [tuple(x) for x in self.waiting["left"].get()]
        self.waiting["left"].clear()
        yield self._frame(key, [(p, None) for p, _ in late])

    def _frame(self, key, pairs):
        import pandas as pd

        out = {k: pd.Series([v] * len(pairs), dtype=object) for k, v in zip(self.keys, key, strict=True)}
        return pd.DataFrame({**out, "pos": pd.Series([p for p, _ in pairs], dtype="int64"), "value": pd.Series([v for _, v in pairs], dtype=object)})

    def close(self) -> None:
        pass


def stream_occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, limit_ms: int | None = None) -> DataFrame:
    """``keys, pos, value``: the occurrence join on streams: left rows (``keys, pos``) with the ``value`` of the right row that is the
    same occurrence of their key, as soon as both have come.

    Rows of one key must arrive in the order of their places.  Keys are strings, null being empty.  What waits is keyed state, kept
    over restarts; with ``limit_ms`` a left row that has waited that long goes out with a null, without it it waits on.  What never
    met a partner is the left side less the result.  A limit needs a stream that runs on, with a processing-time trigger: timers
    keep one that processes what is available from ending.
    """
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k)
    side = lambda df, name, v: df.select(*map(text, keys), F.lit(name).alias("side"), F.col("pos").cast("long").alias("pos"), v.cast("string").alias("value"))
    both = side(left, "left", F.lit(None)).unionByName(side(right, "right", F.col(value)))
    schema = ", ".join(f"{k} string" for k in keys) + ", pos long, value string"
    mode = "None" if limit_ms is None else "ProcessingTime"
    return both.groupBy(*keys).transformWithStateInPandas(_Matcher(keys, limit_ms), schema, "Append", mode)


def stream_question_ids(judgments: DataFrame, predictions: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """``fifo_question_ids`` on streams: ``model, question, answer, pos, qid`` of each judgment whose prediction has come; with
    ``limit_ms`` one that waits longer becomes ``unknown::model::pos``."""
    keyed = lambda df: df.withColumns({c: normalize(c) for c in ("question", "answer")})
    got = stream_occurrence_join(keyed(judgments), keyed(predictions), ["model", "question", "answer"], "qid", limit_ms)
    unknown = F.concat(F.lit("unknown::"), "model", F.lit("::"), F.col("pos").cast("string"))
    return got.select("model", "question", "answer", "pos", F.coalesce("value", unknown).alias("qid"))
