"""Resumable processing, and extensions on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sinks import ragged_union
from ..session import table
from ..streaming import incremental
from . import _data as D
from .registry import query


def _events(spark, sf):
    return table(spark, sf, "events")


@query("resume_anti", "SELECT event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 5 = 0)")
def resume_anti(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "event_type")
    return incremental.pending(e, e.where("event_id % 5 = 0"), ["user_id", "event_type"]).select("event_id")


@query("resume_occurrences", """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
 n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2) SELECT event_id FROM r LEFT JOIN n USING (user_id, event_type) WHERE k > coalesce(n, 0)""")
def resume_occurrences(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "event_type")
    return incremental.pending_occurrences(e, e.where("event_id % 5 = 0"), ["user_id", "event_type"], "event_id").select("event_id")


@query("resume_positions", "SELECT event_id AS pos FROM events WHERE event_id % 2 = 1")
def resume_positions(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("pos"))
    return incremental.pending_positions(e, e.where("pos % 2 = 0"))


@query("resume_union", "SELECT event_id AS pos, event_type FROM events WHERE event_id < 500 UNION ALL SELECT event_id + 500, upper(event_type) FROM events WHERE event_id >= 500")
def resume_union(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("pos"), "event_type")
    return incremental.append_results(e.where("pos < 500"), e.where("pos >= 500").withColumn("event_type", F.upper("event_type")))


@query("summary_ragged_union", "SELECT count(*) AS count, source AS model, NULL::DOUBLE AS total FROM documents GROUP BY source UNION ALL SELECT count(*), lang, sum(n_chars)::DOUBLE FROM documents GROUP BY lang")
def summary_ragged_union(spark, sf):
    d = D.documents(spark, sf)
    return ragged_union(d.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("count")), d.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("count"), F.sum("n_chars").cast("double").alias("total")))


@query("skip_limit", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p >= 100 AND p < 350")
def skip_limit(spark, sf):
    e = _events(spark, sf).select("event_id", "event_type")
    return incremental.window_rows(incremental.place_rows(e, "event_id"), "place", 100, 250).select("event_id", "event_type")


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return incremental.tumbling(_events(spark, sf), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 6))


@query("events_session", """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def events_session(spark, sf):
    return incremental.sessions(_events(spark, sf), "ts", "30 minutes", ["user_id"])


@query("events_dedupe", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def events_dedupe(spark, sf):
    return incremental.first_events(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
