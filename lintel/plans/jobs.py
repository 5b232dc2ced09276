"""Queries on a job log made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.files import STALE_MS
from ..operators import jobs as jb
from ..operators import reports
from .registry import query, table

STATUS = {"signup": "queued", "click": "processing", "view": "processing", "purchase": "done", "error": "error"}
NOW = "2024-01-15 00:00:00"
LIMIT = 1


def joblog(spark, sf_dir):
    """job_id, event_id, ts, status: an append-only log."""
    kind = F.col("event_type")
    status = F.lit(None).cast("string")
    for k, v in STATUS.items():
        status = F.when(kind == k, v).otherwise(status)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


LOG = "joblog as (select user_id as job_id, event_id, ts, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items()) + " end as status from events)"
LAST = f"{LOG}, latest as (select * from joblog qualify row_number() over (partition by job_id order by ts desc, event_id desc) = 1)"


def latest_jobs(spark, sf_dir):
    return jb.latest(joblog(spark, sf_dir), "job_id", ["ts", "event_id"], ["status"])


@query(f"with {LAST} select job_id, event_id, status from latest")
def job_latest(spark, sf_dir):
    return latest_jobs(spark, sf_dir).select("job_id", "event_id", "status")


@query(f"with {LOG} select event_id, status in ('queued', 'error') or (status = 'processing' and epoch_ms(ts) < epoch_ms(timestamp '{NOW}') - {STALE_MS}) as claimable from joblog")
def job_claim(spark, sf_dir):
    now = F.unix_millis(F.lit(NOW).cast("timestamp"))
    return joblog(spark, sf_dir).select("event_id", jb.claimable(F.col("status"), F.unix_millis("ts"), now).alias("claimable"))


@query(
    """with k as (select case when event_id % 10 <> 0 then user_id || '-' || event_type end as key, event_id, ts from events)
    select key, event_id from k where key is null union all select key, event_id from (select * from k where key is not null qualify row_number() over (partition by key order by ts, event_id) = 1)"""
)
def idempotent_first(spark, sf_dir):
    key = F.when(F.col("event_id") % 10 != 0, F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    log = table(spark, sf_dir, "events").select(key.alias("key"), "ts", "event_id")
    return jb.first_by_key(log, "key", ["ts", "event_id"]).select("key", "event_id")


@query(f"with {LAST} select job_id, status, case when status = 'done' then '/api/jobs/' || job_id || '/download' end as download, job_id || '.txt' as original_name, cast(event_id as bigint) as size_bytes from latest")
def job_public_view(spark, sf_dir):
    rows = latest_jobs(spark, sf_dir).select(
        F.col("job_id").alias("id"), "status", F.concat(F.col("job_id").cast("string"), F.lit(".txt")).alias("original_name"), F.lit("text/plain").alias("content_type"), F.lit("txt").alias("extension"), F.col("event_id").alias("size_bytes"),
        F.lit(None).cast("long").alias("cleaned_size_bytes"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("report_summary"), F.lit(1).alias("attempts"), F.unix_millis("ts").alias("created_at"), F.unix_millis("ts").alias("updated_at"),
    )
    return jb.public_view(rows).select(F.col("id").alias("job_id"), "status", "download", F.col("originalName").alias("original_name"), F.col("sizeBytes").alias("size_bytes"))


@query(f"with {LAST} select status, count(*) as n from latest group by status")
def job_status_counts(spark, sf_dir):
    return jb.status_counts(latest_jobs(spark, sf_dir))


@query(f"with {LAST} select job_id from latest where job_id not in (select doc_id from documents where doc_id % 3 = 0)")
def orphan_jobs(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").alias("job_id"))
    return jb.orphans(latest_jobs(spark, sf_dir).select("job_id"), objects)


@query(f"with {LAST} select job_id, status = 'done' as ready, case when status = 'done' then 'uploads/' || job_id || '/cleaned' end as key from latest")
def download_view(spark, sf_dir):
    return reports.download_view(latest_jobs(spark, sf_dir))


@query(
    f"""with {LAST}, o as (select doc_id as job_id, '{{"lang":"' || lang || '"}}' as stored from documents where doc_id % 3 = 0) select l.job_id, coalesce(o.stored, case when l.job_id % 2 = 0 then '{{"kind":"text"}}' end) as report
    from latest l left join o on l.job_id = o.job_id"""
)
def report_view(spark, sf_dir):
    jobs = latest_jobs(spark, sf_dir).select("job_id", F.when(F.col("job_id") % 2 == 0, '{"kind":"text"}').alias("summary"))
    stored = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").alias("job_id"), F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("stored"))
    return reports.report_view(jobs, stored)


@query(
    """select doc_id, 'te"x' || chr(9) || chr(10) || chr(92) || case when doc_id % 2 = 0 then chr(1) else '' end as kind, 'Layer A' as note_start, doc_id % 2 = 0 as has_actions, case when doc_id % 3 <> 0 then doc_id end as removed_count, doc_id % 3 = 1 as has_backend, false as has_secret from documents"""
)
def report_summary(spark, sf_dir):
    k = F.col("doc_id")
    report = F.concat(
        F.lit('{"secret":1'), F.when(k % 2 == 0, ',"actions":["a"]').otherwise(""), F.when(k % 3 != 0, F.concat(F.lit(',"removedCount":'), k.cast("string"))).otherwise(""), F.when(k % 3 == 1, ',"backend":null').otherwise(""), F.lit("}")
    )
    s = table(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(reports.summary_json(F.concat(F.lit('te"x\t\n\\'), F.when(k % 2 == 0, "\u0001").otherwise("")), report)).alias("s"))
    has = lambda f: (F.try_variant_get("s", f"$.{f}", "variant").isNotNull() | F.is_variant_null(F.try_variant_get("s", f"$.{f}", "variant")))
    return s.select(
        "doc_id", F.try_variant_get("s", "$.kind", "string").alias("kind"), F.substring(F.try_variant_get("s", "$.note", "string"), 1, 7).alias("note_start"), has("actions").alias("has_actions"),
        F.try_variant_get("s", "$.removedCount", "bigint").alias("removed_count"), has("backend").alias("has_backend"), has("secret").alias("has_secret"),
    )


@query(f"select user_id, time_bucket(interval '60 seconds', ts) as window_start, count(*) as n, count(*) > {LIMIT} as limited from events group by 1, 2")
def rate_limit_tumbling(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jb.rate_limit_tumbling(events, "user_id", "ts", LIMIT).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"with e as (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as n from events) select event_id, n, n > {LIMIT} as limited from e")
def rate_limit_sliding(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return jb.rate_limit_sliding(events, "user_id", "ts", LIMIT).select("event_id", "n", "limited")


_ID = "printf('%08x-1111-4111-8111-%012x', {0}, {0})"
_JOBS = f"""{LAST}, jobs as (select {_ID.format('job_id')} as id, job_id as k, status, 'report ' || job_id || '.txt' as name, ts, event_id from latest),
  asked as (select job_id as request_id, case job_id % 5 when 0 then 'x' || job_id when 1 then {_ID.format('(job_id + 1000000)')} else {_ID.format('job_id')} end as job_id from latest)"""
_ERROR = "case when not regexp_full_match(a.job_id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then 'invalid_job_id' when j.id is null then 'not_found' when j.status <> 'done' then 'not_ready'"
_HTTP = "case when error is null then 200 when error = 'invalid_job_id' then 400 when error = 'not_ready' then 409 else 404 end as http, error, case when error = 'not_ready' then status end as job_status"


def _requests(spark, sf_dir):
    """(requests, jobs) with ids in the form that jobs have; a fifth of the requests have none such, and a fifth name no job."""
    made = lambda k: F.format_string("%08x-1111-4111-8111-%012x", k, k)
    k = F.col("job_id")
    last = latest_jobs(spark, sf_dir)
    jobs = last.select(made(k).alias("id"), k.alias("k"), "status", F.concat(F.lit("report "), k.cast("string"), F.lit(".txt")).alias("original_name"), F.lit("text/plain").alias("content_type"), F.when(k % 2 == 0, '{"kind":"text"}').otherwise("").alias("report_summary"))
    asked = last.select(k.alias("request_id"), F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 5 == 1, made(k + 1_000_000)).otherwise(made(k)).alias("job_id"))
    return asked, jobs


@query(
    f"""with {_JOBS}, d as (select a.request_id, a.job_id, j.status, j.name, {_ERROR} when j.k % 3 = 0 then 'missing_object' end as error, j.k from asked a left join jobs j on a.job_id = j.id)
    select request_id, {_HTTP}, case when error is null then 'uploads/' || job_id || '/cleaned' end as key, case when error is null then replace(name, '.txt', '.cleaned.txt') end as file_name,
    case when error is null then case when k % 2 = 0 then 'text/markdown' else 'text/plain' end end as content_type from d"""
)
def download_gate(spark, sf_dir):
    asked, jobs = _requests(spark, sf_dir)
    cleaned = jobs.filter("k % 3 <> 0").select(F.col("id").alias("job_id"), F.when(F.col("k") % 2 == 0, "text/markdown").alias("content_type"))
    return reports.download_gate(asked, jobs, cleaned)


@query(
    f"""with {_JOBS}, d as (select a.request_id, a.job_id, j.status, {_ERROR} end as error, j.k from asked a left join jobs j on a.job_id = j.id)
    select request_id, {_HTTP}, case when error is null then case when k % 3 = 0 then '{{"n":' || k || '}}' when k % 2 = 0 then '{{"kind":"text"}}' end end as report from d"""
)
def report_gate(spark, sf_dir):
    asked, jobs = _requests(spark, sf_dir)
    stored = jobs.filter("k % 3 = 0").select(F.col("id").alias("job_id"), F.concat(F.lit('{"n":'), F.col("k").cast("string"), F.lit("}")).alias("stored"))
    return reports.report_gate(asked, jobs, stored)


_STATE = "s as (select job_id as id, status, cast(job_id % 4 as integer) as attempts, epoch_us(ts) // 1000 as updated_at from latest)"
_NOW = f"epoch_ms(timestamp '{NOW}')"


def _state(spark, sf_dir):
    return latest_jobs(spark, sf_dir).select(F.col("job_id").alias("id"), "status", (F.col("job_id") % 4).cast("int").alias("attempts"), F.unix_millis("ts").alias("updated_at"))


@query(
    f"""with {LAST}, {_STATE}, c as (select *, status in ('queued', 'error') or status = 'processing' and updated_at + {STALE_MS} < {_NOW} as claimed from s)
    select id, claimed, case when claimed then 'processing' else status end as status, case when claimed then attempts + 1 else attempts end as attempts, case when claimed then {_NOW} else updated_at end as updated_at from c"""
)
def job_claimed(spark, sf_dir):
    return jb.claim(_state(spark, sf_dir), F.unix_millis(F.lit(NOW).cast("timestamp"))).select("id", "claimed", "status", "attempts", "updated_at")


@query(
    f"""with {LAST}, {_STATE}, r as (select id, case when id % 2 = 0 then 'done' else 'error' end as status, case when id % 2 = 1 then 'boom' end as error, case when id % 2 = 0 then id * 10 end as size, case when id % 2 = 0 then '{{}}' end as summary from s where id % 3 = 0)
    select s.id, coalesce(r.status, s.status) as status, case when r.id is null then 'old' else r.error end as error, r.size as cleaned_size_bytes, r.summary as report_summary, case when r.id is null then s.updated_at else {_NOW} end as updated_at from s left join r on s.id = r.id"""
)
def job_finish(spark, sf_dir):
    state = _state(spark, sf_dir).withColumns({"error": F.lit("old"), "cleaned_size_bytes": F.lit(None).cast("long"), "report_summary": F.lit(None).cast("string")})
    k = F.col("id")
    results = state.filter(k % 3 == 0).select(k, F.when(k % 2 == 0, "done").otherwise("error").alias("status"), F.when(k % 2 == 1, "boom").alias("error"), F.when(k % 2 == 0, k * 10).alias("cleaned_size_bytes"), F.when(k % 2 == 0, "{}").alias("report_summary"))
    return jb.finish(state, results, F.unix_millis(F.lit(NOW).cast("timestamp"))).select("id", "status", "error", "cleaned_size_bytes", "report_summary", "updated_at")


@query(f"with {LAST} select job_id, case when status = 'done' then 'done' else 'queued' end as answer from latest")
def restart_status(spark, sf_dir):
    return latest_jobs(spark, sf_dir).select("job_id", jb.restart_status(F.col("status")).alias("answer"))
