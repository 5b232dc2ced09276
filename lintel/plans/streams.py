"""Queries that run as streams over the events and return what their sinks hold at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as st
from ..operators import jobs as jb
from .jobs import STATUS
from .registry import query


@query()
def stream_claim(spark, sf_dir):
    """The last state of each job: status and attempts."""
    kind = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    log = st.job_events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", F.unix_millis("ts").alias("ts_ms"), kind[F.col("event_type")].alias("status"))
    states = st.run_to_end(st.claims(log), "update")
    return jb.latest(states, "job_id", ["batch"], ["status", "attempts"]).select("job_id", "status", "attempts")


@query("select distinct user_id || '-' || event_type as key from events")
def stream_dedup(spark, sf_dir):
    keyed = st.job_events(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return st.run_to_end(st.dedup(keyed, "key", "ts", "60 days"), "append").select("key")


@query("select user_id, time_bucket(interval '60 seconds', ts) as window_start, count(*) as n from events group by 1, 2")
def stream_rate_limit(spark, sf_dir):
    counts = st.rate_limit(st.job_events(spark, sf_dir), "user_id", "ts", delay="60 days")
    flat = counts.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")
    return st.run_to_end(flat, "complete").select("user_id", "window_start", "n")
