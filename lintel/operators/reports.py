"""Reports: the public summary, and views on jobs and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as fx
from ..functions.text import NOTE

#: Fields of a report that a summary shows where they are there.
SUMMARY_FIELDS = ("actions", "suspicious", "layer_b", "still_has_c2pa", "still_has_ai_metadata", "removedCount", "removed", "backend", "layer", "parts_cleaned")


def summary_json(kind: Column, report: Column) -> Column:
    """A summary as JSON text: kind, note and those fields that the report has, also where they are null there."""
    parsed = F.try_parse_json(report)

    def field(name: str) -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        return F.when(value.isNotNull() | F.is_variant_null(value), F.concat(F.lit(f'"{name}":'), F.to_json(value)))

    quoted = F.to_json(F.struct(F.coalesce(kind, F.lit("")).alias("kind")))
    first = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    note = F.lit(f'"note":"{NOTE}"')
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(first, note, *[field(n) for n in SUMMARY_FIELDS])), ","), F.lit("}"))


def _gate(requests: DataFrame, jobs: DataFrame, found: DataFrame | None, fields: list[str]) -> DataFrame:
    """Requests (request_id, job_id) with the fields of their job, `at` (whether the object is there), and the error that comes first: invalid_job_id, not_found, not_ready."""
    rows = requests.join(jobs.select(F.col("id").alias("__id"), F.col("status").alias("job_status"), *fields), F.col("job_id") == F.col("__id"), "left")
    if found is not None:
        rows = rows.join(found.withColumnRenamed("job_id", "__object").withColumn("at", F.lit(True)), F.col("job_id") == F.col("__object"), "left")
    error = F.when(~fx.job_id_valid(F.col("job_id")), "invalid_job_id").when(F.col("__id").isNull(), "not_found").when(F.col("job_status") != "done", "not_ready")
    return rows.withColumn("error", error)


def _http(error: Column) -> Column:
    return F.when(error.isNull(), 200).when(error == "invalid_job_id", 400).when(error == "not_ready", 409).otherwise(404)


def download_gate(requests: DataFrame, jobs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """What a download answers: request_id, http, error, job_status (of a job that isn't ready), key, file_name and content_type.

    requests: request_id, job_id; jobs: id, status, original_name, content_type, one row each; cleaned: job_id, content_type of the objects that are there, one row each.
    """
    rows = _gate(requests, jobs, cleaned.select("job_id", F.col("content_type").alias("own_type")), ["original_name", F.col("content_type").alias("job_type")])
    error = F.coalesce("error", F.when(F.col("at").isNull(), "missing_object"))
    ok = error.isNull()
    kind = F.coalesce(F.nullif("own_type", F.lit("")), F.nullif("job_type", F.lit("")), F.lit("application/octet-stream"))
    return rows.select(
        "request_id", _http(error).alias("http"), error.alias("error"), F.when(error == "not_ready", F.col("job_status")).alias("job_status"), F.when(ok, fx.object_key(F.col("job_id"), "cleaned")).alias("key"),
        F.when(ok, fx.download_name(F.col("original_name"))).alias("file_name"), F.when(ok, kind).alias("content_type"),
    )


def report_gate(requests: DataFrame, jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """What a request for a report answers: request_id, http, error, job_status and report, the stored one or else the summary; only jobs that are done have one.

    requests: request_id, job_id; jobs: id, status, report_summary; reports: job_id, stored.
    """
    rows = _gate(requests, jobs, reports, ["report_summary"])
    report = F.when(F.col("error").isNull(), F.coalesce("stored", F.nullif("report_summary", F.lit(""))))
    return rows.select("request_id", _http(F.col("error")).alias("http"), "error", F.when(F.col("error") == "not_ready", F.col("job_status")).alias("job_status"), report.alias("report"))


def report_view(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """job_id and its report: the stored one, else the summary, else null."""
    return jobs.join(reports.select("job_id", "stored"), "job_id", "left").select("job_id", F.coalesce("stored", "summary").alias("report"))


def download_view(jobs: DataFrame) -> DataFrame:
    """job_id, whether it is ready, and the key of its cleaned object then."""
    ready = F.col("status") == "done"
    return jobs.select("job_id", ready.alias("ready"), F.when(ready, F.concat(F.lit("uploads/"), F.col("job_id").cast("string"), F.lit("/cleaned"))).alias("key"))
