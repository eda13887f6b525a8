"""Streaming queries, run over all files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.registry import Tables, query
from assayer.streaming import events, jobs


@query("SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_notices(t: Tables) -> DataFrame:
    return events.run_available(events.notices(events.event_stream(t.spark, f"{t.folder}/events.parquet")), "notices")


@query("""
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS starts, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type FROM events)
    WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_window_counts(t: Tables) -> DataFrame:
    return events.run_available(events.window_counts(events.event_stream(t.spark, f"{t.folder}/events.parquet")), "windows")


@query()
def stream_sessions(t: Tables) -> DataFrame:
    return events.run_available(events.sessions(events.event_stream(t.spark, f"{t.folder}/events.parquet")), "sessions")


@query()
def stream_limited(t: Tables) -> DataFrame:
    return events.run_available(events.limited(events.event_stream(t.spark, f"{t.folder}/events.parquet"), 3, 86_400), "limited")


def _actions(t: Tables) -> DataFrame:
    """Users as tenants of a job queue: views enqueue a job for the hour's quarter of the day, clicks claim one, purchases end the one that runs, errors fail it, anything else is a heartbeat. A user's worker is one of two."""
    log = events.event_stream(t.spark, f"{t.folder}/events.parquet")
    action = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "succeed").when(F.col("event_type") == "error", "fail").otherwise("beat")
    return log.select(F.col("user_id").alias("tenant"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("q"), F.floor(F.hour("ts") / 6)).alias("key"), (F.col("event_id") % 2).alias("worker"))


@query()
def stream_jobs(t: Tables) -> DataFrame:
    """What happens to the jobs of a queue, leases of two days that run out by timers included."""
    return jobs.run(jobs.stateful(_actions(t), "tenant", jobs.JobQueue(jobs.Policy(lease_ms=2 * 86_400_000, running=2)), "1 hour"), "jobs")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS job FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def stream_enqueue(t: Tables) -> DataFrame:
    """A job a key, unless one is waiting already: the queue of st_enqueue as a stream."""
    log = events.event_stream(t.spark, f"{t.folder}/events.parquet").where(F.col("event_type").isin("click", "view"))
    rows = log.select(F.col("user_id").alias("tenant"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit("enqueue").alias("action"), F.col("event_type").alias("key"), F.lit(0).cast("long").alias("worker"))
    made = jobs.run(jobs.stateful(rows, "tenant", jobs.JobQueue(jobs.Policy()), "1 hour"), "enqueue").where("what = 'queued'")
    return made.select(F.col("tenant").alias("user_id"), F.col("key").alias("event_type"), "job")


@query("""
    WITH n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS seen FROM events)
    SELECT user_id, event_id, nxt IS NULL OR nxt > ts + INTERVAL 6 HOUR AS expired FROM n WHERE nxt IS NOT NULL OR ts + INTERVAL 6 HOUR <= seen""")
def stream_leases(t: Tables) -> DataFrame:
    """Leases of six hours that the next heartbeat found held or expired, and those that a timer ended without any; the last of some users may hold still."""
    log = events.event_stream(t.spark, f"{t.folder}/events.parquet").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return jobs.run(jobs.stateful(log, "user_id", jobs.Leases(6 * 3_600_000), "1 hour"), "leases")


@query("""
    WITH f AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS reset FROM events), g AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM f),
    n AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id) AS BIGINT) AS failed FROM g)
    SELECT user_id, event_id, failed % 2 AS failed, failed > 0 AND failed % 2 = 0 AS locked FROM n WHERE event_type = 'error'""")
def stream_counters(t: Tables) -> DataFrame:
    """Counters of failures and lockouts of st_lockout, kept as state."""
    log = events.event_stream(t.spark, f"{t.folder}/events.parquet")
    rows = log.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "fail").otherwise("other").alias("action"))
    return jobs.run(jobs.stateful(rows, "user_id", jobs.Counters(2), timers="none"), "counters")
