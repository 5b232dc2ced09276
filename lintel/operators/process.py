"""The whole job: route files, clean each on its branch, and give result rows and reports."""

from __future__ import annotations

import base64
import json
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import batches_of, bounded
from ..functions import files as fx
from ..functions import text as tx
from .. import sources
from . import packages, reports, scrub
from .jobs import rate_limit_sliding

RESULT = ("job_id", "backend", "status", "error", "cleaned", "content_type", "report", "summary")


def process_files(files: DataFrame, transport=None) -> DataFrame:
    """Result rows of files (job_id, name, content_type, content): RESULT's columns, a row per file.

    Text is cleaned in the JVM, packages in a worker. Others go to `transport`, a function of (bytes, name) that gives (status, body) or
    raises; without one they end as cleaner_unconfigured. A file without content ends as missing. One scan and one narrow stage serve all
    routes: a route's columns are null in rows of other routes, so only the bytes of packages and of remote files go to workers.
    """
    bounded(files.sparkSession)
    backend = fx.backend(fx.extension_of(F.col("name")), transport is not None)
    route = F.when(F.col("content").isNull(), "missing").otherwise(backend)
    on = lambda name, value: F.when(F.col("route") == name, value)
    rows = files.select("job_id", "name", F.col("content_type").alias("in_type"), "content", backend.alias("backend"), route.alias("route"))
    rows = rows.withColumns({"docx": packages.clean_package(on("worker-ooxml", F.col("content"))), "text": on("worker-layer-a", tx.decode_utf8(F.col("content")))})
    if transport is None:
        rows = rows.withColumn("remote", F.lit(None).cast("struct<cleaned:binary,kind:string,report:string,error:string>"))
    else:
        rows = rows.withColumn("remote", _remote_column(transport)(on("remote-cleaner", F.col("content")), F.col("name")))
    rows = rows.drop("content").withColumn("dirty", F.col("text").rlike(tx.STRIP_CLASS))
    rows = rows.withColumn("codes", F.when(F.col("dirty"), tx.mark_codes(F.col("text"))).otherwise(F.array().cast("array<string>")))
    head = lambda kind, backend: (F.lit(kind).alias("kind"), F.lit("A").alias("layer"), F.lit(backend).alias("backend"))
    note, d = F.lit(tx.NOTE).alias("note"), F.col("docx")
    text_report = F.to_json(F.struct(*head("text", "worker-layer-a"), F.size("codes").alias("removedCount"), tx.histogram(F.col("codes")).alias("removed"), note))
    docx_report = F.to_json(F.struct(*head("docx", "worker-ooxml"), d["removed_count"].alias("removedCount"), *[d[c].alias(c) for c in ("removed", "parts_cleaned", "actions", "still_has_c2pa")], note))
    error = (
        F.when(F.col("route") == "missing", "original object missing").when(F.col("route") == "cleaner_unconfigured", "cleaner_unconfigured")
        .when((F.col("route") == "worker-layer-a") & F.col("text").isNull(), scrub.NOT_UTF8).otherwise(F.coalesce(d["error"], F.col("remote.error")))
    )
    rows = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    cleaned = F.coalesce(F.when(F.col("dirty"), tx.strip_marks(F.col("text"))).otherwise(F.col("text")).cast("binary"), d["cleaned"], F.col("remote.cleaned"))
    media = on("worker-layer-a", F.lit(scrub.TEXT_TYPE)).when(F.col("route") == "worker-ooxml", fx.PACKAGE_TYPE).when(F.col("route") == "remote-cleaner", F.col("in_type"))
    report = F.when(ok, on("worker-layer-a", text_report).when(F.col("route") == "worker-ooxml", docx_report).otherwise(F.col("remote.report")))
    kind = on("worker-layer-a", F.lit("text")).when(F.col("route") == "worker-ooxml", "docx").otherwise(F.col("remote.kind"))
    rows = rows.select("job_id", "backend", "error", cleaned.alias("cleaned"), media.alias("content_type"), report.alias("report"), kind.alias("kind"))
    summary = F.when(ok, reports.summary_json(F.col("kind"), F.coalesce("report", F.lit("{}"))))
    return rows.select("job_id", "backend", F.when(ok, "done").otherwise("error").alias("status"), tx.sanitize_error(F.col("error")).alias("error"), "cleaned", "content_type", "report", summary.alias("summary"))


def _ask(transport, data: bytes, name: str, attempts: int, first_ms: int) -> tuple[dict, int]:
    """cleaned, kind, report and error of one file, asked for up to `attempts` times, and how often it was."""

    def once():
        try:
            status, body = transport(data, name)
        except Exception as e:  # whatever kept the reply from coming
            return 503, f"cleaner_unreachable: {e}", None
        try:
            reply = json.loads(body)
        except (TypeError, ValueError):
            reply = None
        if not isinstance(reply, dict):
            return status, f"cleaner_bad_json status={status}", None
        if not 200 <= status <= 299 or reply.get("ok") is False:
            return status, next((reply[k] for k in ("error", "message") if isinstance(reply.get(k), str)), f"cleaner HTTP {status}"), None
        if not isinstance(reply.get("cleaned"), str):
            return 502, "cleaner_missing_cleaned", None
        return status, None, reply

    for n in range(1, attempts + 1):
        status, error, reply = once()
        low = (error or "").lower()
        if error is None or n == attempts or not (status >= 500 or status == 0 or "unreachable" in low or "timeout" in low):
            break
        time.sleep(first_ms * 2 ** (n - 1) / 1000)
    if error:
        return {"cleaned": None, "kind": None, "report": None, "error": error}, n
    return {"cleaned": base64.b64decode(reply["cleaned"]), "kind": reply["kind"] if isinstance(reply.get("kind"), str) else "unknown", "report": json.dumps(reply.get("report")), "error": None}, n


def _remote_column(transport, attempts: int = fx.MAX_ATTEMPTS, first_ms: int = fx.BACKOFF_MS):
    """A column of the service's answers; null bytes are not sent."""
    kind = pa.struct([("cleaned", pa.binary()), ("kind", pa.string()), ("report", pa.string()), ("error", pa.string())])

    def run(contents: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if c is None else _ask(transport, c, n, attempts, first_ms)[0] for c, n in zip(contents.to_pylist(), names.to_pylist())], kind)

    return F.arrow_udf(run, "cleaned binary, kind string, report string, error string").asNondeterministic()


_REMOTE = pa.schema([("cleaned", pa.binary()), ("kind", pa.string()), ("report", pa.string()), ("content_type", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])


def call_remote(files: DataFrame, transport, attempts: int = fx.MAX_ATTEMPTS, first_ms: int = fx.BACKOFF_MS) -> DataFrame:
    """job_id, cleaned, kind, report, content_type, error and attempts of files sent to a remote service, up to `attempts` times each."""
    bounded(files.sparkSession)
    kind = files.schema["job_id"].dataType.simpleString()

    def rows(b):
        for key, data, name, media in zip(*b.columns):
            row, n = _ask(transport, data.as_py(), name.as_py(), attempts, first_ms)
            yield {"job_id": key.as_py(), **row, "content_type": media.as_py(), "attempts": n}, len(row["cleaned"] or b"") + len(row["report"] or "")

    def run(batches):
        for b in batches:
            yield from batches_of(rows(b), pa.schema([("job_id", b.schema.field(0).type), *_REMOTE]))

    columns = ["job_id", "content", "name", "content_type"]
    return files.select(*columns).mapInArrow(run, f"job_id {kind}, cleaned binary, kind string, report string, content_type string, error string, attempts int")


#: What a refused upload answers, where it isn't 400.
UPLOAD_STATUS = {"rate_limited": 429, "file_too_large": 413}


def upload_gate(requests: DataFrame, jobs: DataFrame, limit: int = 30, seconds: int = 60, cap: int = fx.MAX_BYTES) -> DataFrame:
    """What each upload answers: request_id, http, error, job_id, replayed, and name, content_type, extension, size_bytes and idempotency_key of new jobs.

    requests: request_id (the id of a job that it opens), client, ts, content_length, content_type, idempotency_key, body; jobs: id, idempotency_key, one row
    a key. The first that holds counts: over the rate limit, declared too long, no multipart form, no file, not admitted; then a known key answers its
    job, and of requests with one new key the earliest opens a job that the others answer. Bodies are read where they lie: only names and
    sizes are dealt out. A request without a key never shares a job, and has a partition of its own hash, however many there are.
    """
    bounded(requests.sparkSession)
    long = F.coalesce(fx.header_too_large(F.col("content_length"), cap), F.lit(False))
    part = sources.upload_part(F.col("content_type"), F.when(~long, F.coalesce("body", F.lit(b""))))
    rows = requests.select("request_id", "client", "ts", long.alias("long"), F.nullif(tx.trimmed(F.col("idempotency_key")), F.lit("")).alias("idempotency_key"), part.alias("part"))
    rows = rate_limit_sliding(rows, "client", "ts", limit, seconds)
    name = F.coalesce(F.nullif("part.name", F.lit("")), F.lit("upload.bin"))
    admitted = fx.admission(name, F.col("part.type"), F.col("part.size"), cap)
    error = F.when(F.col("limited"), "rate_limited").when(F.col("long"), "file_too_large").otherwise(F.coalesce("part.error", F.nullif(admitted, F.lit("ok"))))
    rows = rows.select("request_id", "ts", "idempotency_key", error.alias("error"), name.alias("name"), F.col("part.type").alias("content_type"), F.col("part.size").alias("size_bytes"))
    meet = lambda key: F.concat(F.lit("k"), key)
    asked = F.when(F.col("error").isNull(), meet(F.col("idempotency_key")))
    rows = rows.withColumn("__meet", F.coalesce(asked, F.concat(F.lit("r"), F.col("request_id").cast("string"))))
    known = jobs.filter("idempotency_key is not null").select(meet(F.col("idempotency_key")).alias("__meet"), F.col("id").alias("__known"))
    first = rows.filter(F.startswith("__meet", F.lit("k"))).groupBy("__meet").agg(F.min(F.struct("ts", "request_id"))["request_id"].alias("__first"))
    rows = rows.join(known, "__meet", "left").join(first, "__meet", "left")
    ok = F.col("error").isNull()
    job = F.when(ok, F.coalesce("__known", "__first", "request_id"))
    replayed_ = ok & (F.col("__known").isNotNull() | F.coalesce(F.col("__first") != F.col("request_id"), F.lit(False)))
    rows = rows.withColumns({"job_id": job, "replayed": replayed_})
    refused = F.lit(400)
    for code, status in UPLOAD_STATUS.items():
        refused = F.when(F.col("error") == code, status).otherwise(refused)
    new = lambda column: F.when(ok & ~F.col("replayed"), column)
    http = F.when(~ok, refused).when(F.col("replayed"), 200).otherwise(202)
    return rows.select("request_id", http.alias("http"), "error", "job_id", "replayed", *[new(F.col(c)).alias(c) for c in ("name", "content_type")], new(fx.extension_of(F.col("name"))).alias("extension"), *[new(F.col(c)).alias(c) for c in ("size_bytes", "idempotency_key")])


def replayed(uploads: DataFrame, jobs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Uploads with the job that their key already has, and whether there is one; uploads without a key never have one."""
    known = jobs.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col("job_id").alias("known_job"))
    return uploads.join(known, F.col(key) == F.col("__key"), "left").withColumn("replayed", F.col("known_job").isNotNull()).drop("__key")


def precheck(name, size, remote: bool = True):
    """What a client says before it sends a file: the first that holds, or ok."""
    base = F.regexp_extract(name, fx.LAST_SEGMENT, 1)
    ext = F.when(F.instr(base, ".") > 0, F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))).otherwise("")
    mine = ext.isin(*tx.TEXT_EXTENSIONS, *fx.PACKAGE_EXTENSIONS)
    return (
        F.when(ext.isin("doc", "docm"), "save_as_docx").when(~ext.isin(*fx.ALLOWED), "extension_not_allowed").when(size <= 0, "empty_file").when(size > fx.MAX_BYTES, "file_too_large")
        .when(~mine & F.lit(not remote), "needs_remote").otherwise("ok")
    )


