"""Queries on uploads, bodies and the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import files as fx
from ..operators import jobs, packages, process
from .admission import NAMES, ext_sql, names
from .net import values
from .registry import INJ, injected, query, table
from .scrub import CLASS, COUNT

NOW_MS = 1_704_067_200_000


@query(
    f"""with {NAMES} select doc_id as id, 'queued' as status, name as original_name, content_type, {ext_sql('name')} as extension, size as size_bytes, cast(null as bigint) as cleaned_size_bytes, cast(null as varchar) as error,
    cast(null as varchar) as report_summary, case when doc_id % 2 = 0 then 'k' || doc_id end as idempotency_key, 0 as attempts, {NOW_MS}::bigint as created_at, {NOW_MS}::bigint as updated_at from names"""
)
def job_insert(spark, sf_dir):
    k = F.col("doc_id")
    uploads = names(spark, sf_dir).select(k.alias("id"), F.col("name").alias("original_name"), "content_type", fx.extension_of(F.col("name")).alias("extension"), F.col("size").alias("size_bytes"), F.when(k % 2 == 0, F.concat(F.lit("k"), k.cast("string"))).alias("idempotency_key"))
    return jobs.new_jobs(uploads, F.lit(NOW_MS).cast("long"))


BODIES = (
    ("1", '{"jobId": "11111111-1111-4111-8111-111111111111"}', "11111111-1111-4111-8111-111111111111", None), ("2", '{"job_id": "11111111-1111-4111-8111-111111111112", "id": "x"}', "11111111-1111-4111-8111-111111111112", None),
    ("3", '{"id": "nope"}', None, "invalid_job_id"), ("4", "{", None, "invalid_json"), ("5", "{}", None, "invalid_job_id"), ("6", None, None, "invalid_json"), ("7", '{"jobId": 5}', None, "invalid_job_id"),
)


@query(f"select case_id, job_id, error from {values('case_id, job_id, error', [(b[0], b[2], b[3]) for b in BODIES])}")
def restart_request(spark, sf_dir):
    rows = spark.createDataFrame([b[:2] for b in BODIES], "case_id string, body string")
    return rows.select("case_id", sources.restart_id(F.col("body")).alias("r")).select("case_id", "r.*")


@query("select event_id, case when user_id % 2 = 0 and event_id % 10 <> 0 then user_id end as known_job, user_id % 2 = 0 and event_id % 10 <> 0 as replayed from events")
def idempotent_replay(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"))
    uploads = events.select("event_id", F.when(F.col("event_id") % 10 != 0, key).alias("idempotency_key"))
    jobs = events.filter(F.col("user_id") % 2 == 0).select(F.col("user_id").alias("job_id"), key.alias("idempotency_key")).distinct()
    return process.replayed(uploads, jobs).select("event_id", "known_job", "replayed")


@query(
    f"""with {NAMES}, e as (select doc_id, {ext_sql('name')} as ext, size from names) select doc_id, case when ext not in ('txt', 'md', 'html', 'docx', 'pdf', 'png') then 'extension_not_allowed' when size <= 0 then 'empty_file'
    when ext in ('pdf', 'png') then 'needs_remote' else 'ok' end as hint from e"""
)
def client_precheck(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", process.precheck(F.col("name"), F.col("size"), remote=False).alias("hint"))


@query(
    f"""with {INJ}, f as (select doc_id, t, doc_id % 5 as k from inj) select doc_id as job_id, case k when 0 then 'worker-layer-a' when 1 then 'worker-ooxml' when 2 then 'cleaner_unconfigured' when 3 then 'worker-layer-a' else 'worker-ooxml' end as backend,
    case when k in (0, 4) then 'done' else 'error' end as status, case k when 1 then 'not_docx: the bytes are no package of parts (the older .doc format can''t be cleaned)' when 2 then 'cleaner_unconfigured' when 3 then 'original object missing' end as error,
    case when k in (0, 4) then cast({COUNT} as bigint) end as removed, case k when 0 then octet_length(encode(regexp_replace(t, {CLASS}, '', 'g'))) end as text_bytes from f"""
)
def process_files(spark, sf_dir):
    """Files of every route: text, a broken package, one for a remote service that isn't there, one without content, and a whole package."""
    k = F.col("doc_id") % 5
    entry = lambda part, data: F.struct(F.lit(part).alias("part"), data.cast("binary").alias("data"), F.lit(0).alias("dos_time"), F.lit(0).alias("dos_date"), F.lit(0).cast("long").alias("ext_attr"), F.lit(False).alias("stored"))
    body = F.when(k == 4, F.array(entry("word/document.xml", F.concat(F.lit("<w:t>"), F.col("t"), F.lit("</w:t>")))))
    made = injected(spark, sf_dir).select("doc_id", F.when(k != 3, F.col("t").cast("binary")).alias("plain"), packages.package_of(body).alias("package"))
    k = F.col("doc_id") % 5
    end = F.when(k.isin(1, 4), ".docx").when(k == 2, ".pdf").otherwise(".txt")
    files = made.select(F.col("doc_id").alias("job_id"), F.concat(F.lit("f"), end).alias("name"), F.lit(None).cast("string").alias("content_type"), F.coalesce("package", "plain").alias("content"))
    done = process.process_files(files)
    size = F.when(F.col("content_type") == "text/plain; charset=utf-8", F.octet_length("cleaned").cast("long"))
    return done.select("job_id", "backend", "status", "error", F.try_variant_get(F.try_parse_json("summary"), "$.removedCount", "bigint").alias("removed"), size.alias("text_bytes"))


KINDS = ("text/plain", "message/rfc822", "multipart/related; boundary=inner", "Application/Octet-Stream")


@query(
    """select doc_id, case when doc_id % 3 = 0 then 'n' || doc_id || '.txt' end as name, case when doc_id % 3 = 0 then (['text/plain', 'message/rfc822', 'multipart/related', 'application/octet-stream'])[doc_id % 4 + 1] end as type,
    case doc_id % 3 when 1 then 'unsupported_media' when 2 then 'missing_file' end as error, case when doc_id % 3 = 0 then sha256(text || chr(13) || chr(10)) end as digest from documents"""
)
def multipart_upload(spark, sf_dir):
    """Bodies whose file is of several types, as it comes, with a line break at its end."""
    k = F.col("doc_id")
    field = F.when(k % 3 == 2, "other").otherwise("file")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 4 + 1).cast("int"))
    first = F.lit('--b0undary\r\nContent-Disposition: form-data; name="x"\r\n\r\n1\r\n')
    head = F.concat(first, F.lit('--b0undary\r\nContent-Disposition: form-data; name="'), field, F.lit('"; filename="n'), k.cast("string"), F.lit('.txt"\r\nContent-Type: '), kind, F.lit("\r\n\r\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 1, "application/json").otherwise("Multipart/form-data; boundary=b0undary").alias("content_type"), F.concat(head, "text", F.lit("\r\n\r\n--b0undary--\r\n")).cast("binary").alias("body"))
    return sources.parse_uploads(rows, "doc_id").select("doc_id", "name", "type", "error", F.sha2("content", 256).alias("digest"))


@query(
    f"""with {NAMES} select doc_id, '{{"jobId":"j' || doc_id || '","originalName":' || to_json(name) || ',"contentType":' || coalesce(to_json(content_type), 'null') || ',"sizeBytes":' || size || ',"createdAt":{NOW_MS}}}' as meta from names"""
)
def upload_meta(spark, sf_dir):
    k = F.col("doc_id")
    return names(spark, sf_dir).select("doc_id", sources.upload_meta(F.concat(F.lit("j"), k.cast("string")), F.col("name"), F.col("content_type"), F.col("size"), F.lit(NOW_MS).cast("long")).alias("meta"))


@query(
    f"""with r as (select doc_id, doc_id + 100 * (doc_id // 50) as s, coalesce(text, '') as text, case when doc_id % 13 = 3 then null when doc_id % 3 = 0 then 'known' || doc_id % 5 else 'k' || doc_id // 4 end as key,
      case doc_id % 7 when 0 then 'exe' when 1 then 'pdf' else 'txt' end as ext from documents),
    n as (select *, count(*) over (order by s range between 59 preceding and current row) as n from r),
    e as (select *, case when n > 30 then 'rate_limited' when doc_id % 17 = 0 then 'file_too_large' when doc_id % 19 = 0 then 'unsupported_media' when doc_id % 23 = 0 then 'missing_file' when text = '' then 'empty_file'
      when ext = 'exe' then 'extension_blocked' when doc_id % 29 = 0 then 'content_type_blocked' end as error from n),
    f as (select *, case when error is null then min(case when error is null then doc_id end) over (partition by key) end as first from e),
    j as (select *, case when error is not null then null when key like 'known%' then -1 - doc_id % 5 when key is null then doc_id else first end as job_id from f)
    select doc_id as request_id, case when error = 'rate_limited' then 429 when error = 'file_too_large' then 413 when error is not null then 400 when job_id <> doc_id then 200 else 202 end as http, error, job_id,
      error is null and job_id <> doc_id as replayed, case when job_id = doc_id then 'n' || doc_id || '.' || ext end as name, case when job_id = doc_id then ext end as extension,
      case when job_id = doc_id then octet_length(encode(text)) end as size_bytes, case when job_id = doc_id then key end as idempotency_key from j"""
)
def upload_gate(spark, sf_dir):
    """Uploads of one client in bursts of fifty, of all sorts, a fifth of the keys known and others shared by requests next to each other."""
    k = F.col("doc_id")
    ext = F.when(k % 7 == 0, "exe").when(k % 7 == 1, "pdf").otherwise("txt")
    kind = F.when(k % 29 == 0, "Application/x-msdownload ; q=1").otherwise("text/plain")
    head = F.concat(F.lit('--edge\r\nContent-Disposition: form-data; name="'), F.when(k % 23 == 0, "other").otherwise("file"), F.lit('"; filename="n'), k.cast("string"), F.lit("."), ext, F.lit('"\r\nContent-Type: '), kind, F.lit("\r\n\r\n"))
    key = F.when(k % 13 != 3, F.when(k % 3 == 0, F.concat(F.lit("known"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("\tk"), F.floor(k / 4).cast("string"), F.lit(" "))))
    requests = table(spark, sf_dir, "documents").select(
        k.alias("request_id"), F.lit("client").alias("client"), F.timestamp_seconds(k + 100 * F.floor(k / 50)).alias("ts"), F.when(k % 17 == 0, fx.MAX_BYTES + fx.HEADER_SLACK + 1).otherwise(1000).alias("content_length"),
        F.when(k % 19 == 0, "text/plain").otherwise("multipart/form-data; boundary=edge").alias("content_type"), key.alias("idempotency_key"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\r\n--edge--\r\n")).cast("binary").alias("body"),
    )
    jobs = spark.range(5).select((-1 - F.col("id")).alias("id"), F.concat(F.lit("known"), F.col("id").cast("string")).alias("idempotency_key"))
    return process.upload_gate(requests, jobs).drop("content_type")
