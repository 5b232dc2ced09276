"""The job log: an append-only table of states, with its latest rows, claims and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import BACKOFF_MS, MAX_ATTEMPTS, STALE_MS


def new_jobs(uploads: DataFrame, now_ms: Column) -> DataFrame:
    """Rows of new jobs from uploads (id, original_name, content_type, extension, size_bytes, idempotency_key): queued, with no attempt yet."""
    none = lambda kind: F.lit(None).cast(kind)
    return uploads.select(
        "id", F.lit("queued").alias("status"), "original_name", "content_type", "extension", "size_bytes", none("long").alias("cleaned_size_bytes"), none("string").alias("error"), none("string").alias("report_summary"), "idempotency_key",
        F.lit(0).alias("attempts"), now_ms.alias("created_at"), now_ms.alias("updated_at"),
    )


def latest(log: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """The last state of each job. Each task keeps one row a key before rows are dealt out, so a busy job costs no more than others."""
    last = F.max(F.struct(*order, *carry)).alias("last")
    return log.groupBy(key).agg(last).select(key, "last.*")


def first_by_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The earliest row of each idempotency key; rows without a key never collide."""
    columns = [c for c in log.columns if c not in (key, *order)]
    first = log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *columns)).alias("first")).select(key, "first.*")
    return first.unionByName(log.filter(F.col(key).isNull()).select(*first.columns))


def claimable(status: Column, updated_ms: Column, now_ms: Column) -> Column:
    """queued and error can be claimed, and processing that is older than the limit (strictly)."""
    return status.isin("queued", "error") | ((status == "processing") & (updated_ms < now_ms - STALE_MS))


def claim(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Jobs after a claim at now: status, attempts and updated_at of those that can be claimed, and whether they were."""
    ok = claimable(F.col("status"), F.col("updated_at"), now_ms)
    return jobs.withColumn("claimed", ok).withColumns({"status": F.when(F.col("claimed"), "processing").otherwise(F.col("status")), "attempts": F.col("attempts") + F.col("claimed").cast("int"), "updated_at": F.when(F.col("claimed"), now_ms).otherwise(F.col("updated_at"))})


def finish(jobs: DataFrame, results: DataFrame, now_ms: Column) -> DataFrame:
    """Jobs with their results (id, status, error, cleaned_size_bytes, report_summary); what a result lacks becomes null."""
    r = results.select(F.col("id"), *[F.col(c).alias(f"__{c}") for c in ("status", "error", "cleaned_size_bytes", "report_summary")], F.lit(True).alias("__done"))
    out = jobs.join(r, "id", "left")
    for c in ("status", "error", "cleaned_size_bytes", "report_summary"):
        out = out.withColumn(c, F.when(F.col("__done"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.withColumn("updated_at", F.when(F.col("__done"), now_ms).otherwise(F.col("updated_at"))).drop("__done", *[f"__{c}" for c in ("status", "error", "cleaned_size_bytes", "report_summary")])


def restart_status(status: Column) -> Column:
    """What a restart answers: a finished job stays, any other is queued again."""
    return F.when(status == "done", status).otherwise("queued")


def public_view(jobs: DataFrame) -> DataFrame:
    """The public columns of a job; the summary as JSON, or as a string where it isn't; a link only when done."""
    summary = F.when(F.col("report_summary") != "", F.coalesce(F.try_parse_json("report_summary"), F.to_variant_object(F.struct(F.col("report_summary").alias("raw")))))
    link = F.when(F.col("status") == "done", F.concat(F.lit("/api/jobs/"), F.col("id").cast("string"), F.lit("/download")))
    names = {"originalName": "original_name", "contentType": "content_type", "sizeBytes": "size_bytes", "cleanedSizeBytes": "cleaned_size_bytes", "createdAt": "created_at", "updatedAt": "updated_at"}
    return jobs.select(F.lit(True).alias("ok"), "id", "status", "extension", "error", "attempts", *[F.col(v).alias(k) for k, v in names.items()], summary.alias("reportSummary"), link.alias("download"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def orphans(jobs: DataFrame, objects: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs without an object."""
    return jobs.join(objects.select(key), key, "left_anti")


def broken_states(jobs: DataFrame) -> DataFrame:
    """Rows that break what the table promises: a known status, an id and a name."""
    return jobs.filter(~F.coalesce(F.col("status").isin("queued", "processing", "done", "error"), F.lit(False)) | F.col("id").isNull() | F.col("original_name").isNull())


def retry_schedule(spark, attempts: int = MAX_ATTEMPTS, first_ms: int = BACKOFF_MS) -> DataFrame:
    """The wait before each attempt: none, then doubling from first_ms."""
    one = spark.range(1, attempts + 1).select(F.col("id").alias("attempt"))
    delay = F.when(F.col("attempt") == 1, F.lit(0)).otherwise(F.lit(first_ms) * F.pow(F.lit(2), F.col("attempt") - 2)).cast("long")
    total = F.when(F.col("attempt") == 1, F.lit(0)).otherwise(F.lit(first_ms) * (F.pow(F.lit(2), F.col("attempt") - 1) - 1)).cast("long")
    return one.select("attempt", delay.alias("delay_ms"), total.alias("cumulative_ms"))


def rate_limit_tumbling(requests: DataFrame, key: str, ts: str, limit: int = 30, period: str = "60 seconds") -> DataFrame:
    """Requests of each key in each period, and whether they are over the limit."""
    counts = requests.groupBy(key, F.window(ts, period)).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def rate_limit_sliding(requests: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Requests of the same key in the last `seconds` up to each one, itself included, and whether they are over the limit.

    Keys are dealt out with the hour, so that a busy key is many groups: rows of the last `seconds` of an hour are also given to the next one.
    """
    from pyspark.sql import Window

    slot = 3600 * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.withColumn("__us", us).withColumn("__slot", F.floor(F.col("__us") / slot)).withColumn("__own", F.lit(True))
    late = rows.filter(F.pmod(F.col("__us"), F.lit(slot)) > slot - seconds * 1_000_000).withColumn("__slot", F.col("__slot") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy(key, "__slot").orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = rows.unionByName(late).withColumn("n", F.count("*").over(w)).filter("__own")
    return counted.withColumn("limited", F.col("n") > limit).drop("__us", "__slot", "__own")
