"""Queries that run a stream over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.plans.registry import query
from evigraph.streaming import events as ev


@query("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, d):
    s = ev.read_events(spark, d)
    twice = s.union(s.select(*s.columns))
    return ev.run_once(ev.deduplicated(twice, "40 days").select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_filter", "SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'signup')")
def stream_filter(spark, d):
    return ev.run_once(ev.live(ev.read_events(spark, d), ["error", "signup"]).select("event_id", "user_id"), "live")


@query("stream_usage", "SELECT user_id, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def stream_usage(spark, d):
    return ev.run_once(ev.usage(ev.read_events(spark, d)), "usage", "complete").select("user_id", "events", F.round("value", 4).alias("value"))


@query("stream_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window(spark, d):
    out = ev.run_once(ev.windowed(ev.read_events(spark, d), "1 day"), "window", "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_timer")
def stream_timer(spark, d):
    return ev.run_once(ev.expiring(ev.read_events(spark, d), 86_400_000), "timer")
