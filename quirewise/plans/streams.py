"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirewise.plans.registry import query
from quirewise.streaming import progress as P


def _updates(v):
    return P.run_updates(P.read_events(v.spark, v.sf_dir))


@query("st_events", "SELECT event_id, CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'layout' WHEN 'signup' THEN 'text' WHEN 'purchase' THEN 'export' ELSE 'ai' END AS stage FROM events")
def st_events(v):
    return P.run_once(_updates(v).select("event_id", "stage"), "append")


@query("st_progress", "SELECT stage, count(*) AS total, count(*) FILTER (status = 'ok') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, CAST(sum(CASE WHEN status <> 'running' THEN elapsed_ms ELSE 0 END) AS BIGINT) AS elapsed_ms FROM runs GROUP BY 1")
def st_progress(v):
    return P.run_once(P.progress(_updates(v)), "complete")


@query("st_windows", "SELECT strftime(ts, '%Y-%m-%d') AS start, stage, count(*) AS n FROM (SELECT e.ts, r.stage FROM events e JOIN runs r ON e.event_id = r.run_id) GROUP BY 1, 2")
def st_windows(v):
    return P.run_once(P.windowed(_updates(v)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "stage", "n")


@query("st_page_states", "SELECT page_index, max(run_id) AS event_id, max_by(status, run_id) AS status, count(*) AS seen FROM runs GROUP BY 1")
def st_page_states(v):
    rows = P.run_once(P.page_states(_updates(v)), "update")
    return rows.groupBy("page_index").agg(F.max("event_id").alias("event_id"), F.max_by("status", F.struct("seen", "event_id")).alias("status"), F.max("seen").alias("seen"))


@query("st_heartbeat", "SELECT user_id FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-30 23:00:00') - floor(epoch(max(ts))) > 60")
def st_heartbeat(v):
    return P.stale_locks(v.table("events"), "2024-01-30 23:00:00").select("user_id")


@query("st_resume", "SELECT page_index, stage, CASE WHEN s = 'running' THEN 'queued' ELSE s END AS status FROM (SELECT page_index, stage, max_by(status, run_id) AS s FROM runs GROUP BY 1, 2)")
def st_resume(v):
    """Pages still running when the log ends go back to the queue; finished ones don't. The log is a stream whose sink was stopped and started again."""
    rows = P.restarted(_updates(v).select("event_id", "stage", "status", "page_index"))
    last = rows.groupBy("page_index", "stage").agg(F.max_by("status", "event_id").alias("status"))
    return last.select("page_index", "stage", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")).alias("status"))


@query("st_control", "SELECT user_id AS job, CASE max_by(event_type, event_id) WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'running' ELSE 'cancelled' END AS state FROM events GROUP BY 1")
def st_control(v):
    """A job's state is its last control event: start, pause, resume or cancel."""
    events = P.read_events(v.spark, v.sf_dir).groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("event"))
    last = P.run_once(events, "complete")
    return last.select("job", F.when(F.col("event").isin("view", "signup"), "running").when(F.col("event") == "click", "paused").otherwise("cancelled").alias("state"))
