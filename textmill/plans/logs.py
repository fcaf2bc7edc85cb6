"""Logs, snapshots and stores over events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from ..operators.dedup import last_per_key
from .registry import Tables, query


@query(
    """SELECT user_id, round(greatest(epoch_us(ts) - epoch_us(t0), 0) / 1e6, 3) AS seconds FROM
(SELECT user_id, event_type, ts, lag(event_type) OVER w AS k0, lag(ts) OVER w AS t0 FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'purchase' AND k0 = 'click'"""
)
def event_pairing_seconds(t: Tables):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return logs.paired_seconds(e, ["user_id"], "event_type", "ts", ["ts", "event_id"], "click", "purchase").select("user_id", F.round("seconds", 3).alias("seconds"))


@query("SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click', 'purchase')) WHERE n = 1 AND event_type = 'click'")
def active_intervals(t: Tables):
    return logs.still_open(t.events, ["user_id"], "event_type", ["ts", "event_id"], "click", "purchase")


@query("SELECT url, max(page_id) AS page_id, length(arg_max(html, page_id)) AS chars FROM pages GROUP BY url")
def latest_snapshot_per_url(t: Tables):
    return last_per_key(t.pages, ["url"], ["page_id"]).select("url", "page_id", F.char_length("html").cast("long").alias("chars"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def url_host_counts(t: Tables):
    return t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


@query("SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 450)")
def erased_by_tombstone(t: Tables):
    return logs.without_erased(t.events, t.events.where("value > 450"), "user_id").select("user_id", "event_id")


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 490)) WHERE n = 1"""
)
def compacted_store(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return logs.compact(e, e.where("value > 490"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(t: Tables):
    return logs.not_done(t.events.select("event_id"), t.lineitem.select(F.col("l_orderkey").alias("event_id")), "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def nested_path_get(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counts(t: Tables):
    """Not in the reference: event-time windows for the events table."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")["start"]
    return t.events.groupBy("event_type", F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
