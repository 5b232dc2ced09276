"""The job state machine as streams: claims in keyed state, deduplication and rate limits with watermarks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.files import STALE_MS
from ..operators import process
from ..sources import write_objects

CLAIMS = "job_id long, status string, attempts long, updated_ms long"


def job_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The events table as a stream of its files, with a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return stream.parquet(f"{sf_dir}/{name}.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay; state is dropped behind it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def rate_limit(stream: DataFrame, key: str, ts: str, period: str = "60 seconds", delay: str = "5 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(key, F.window(ts, period)).agg(F.count("*").alias("n"))


def step(state: tuple[str, int, int] | None, status: str, at: int) -> tuple[str, int, int]:
    """The state machine, one event: (status, attempts, updated_ms).

    queued opens a job once. processing asks for a claim, which queued, error and stale processing grant. done and error finish a job that is being processed.
    """
    if state is None:
        return ("queued", 0, at)
    now, attempts, updated = state
    if status == "processing" and (now in ("queued", "error") or now == "processing" and updated < at - STALE_MS):
        return ("processing", attempts + 1, at)
    if status in ("done", "error") and now == "processing":
        return (status, attempts, at)
    return state


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else None
    rows = [r for b in batches for r in zip(b["ts_ms"], b["event_id"], b["status"])]
    for at, _, status in sorted(rows):
        now = step(now, status, int(at))
    state.update(now)
    yield pd.DataFrame([(key[0], now[0], now[1], now[2])], columns=["job_id", "status", "attempts", "updated_ms"])


def claims(log: DataFrame) -> DataFrame:
    """The state of each job after each micro-batch, from (job_id, event_id, ts_ms, status): one writer a key, so a claim has one winner."""
    return log.groupBy("job_id").applyInPandasWithState(_advance, CLAIMS, "status string, attempts long, updated_ms long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Run over what is there and return what the sink has: a Parquet folder with one batch below another.

    The folder is in spark.checkpoint.dir where that is set, else a temporary one if Spark runs in one process. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = path or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
    base = base or "file://" + tempfile.mkdtemp(prefix="lintel-stream-")
    at = f"{base.rstrip('/')}/lintel-stream-{uuid.uuid4().hex}"

    def write(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")


def clean_arrivals(spark: SparkSession, folder: str, out: str, state: str, transport=None, once: bool = True):
    """Clean files as they arrive in a folder: objects (cleaned, report.json) by kind below `out`/objects, result rows below `out`/results.

    The file's address is its job id. A batch that runs again after a failure writes its own folder again, so no file is there twice. Returns the query.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select(F.col("path").alias("job_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.lit(None).cast("string").alias("content_type"), "content")

    def write(df, batch):
        done = process.process_files(df, transport).persist()
        cleaned = done.select("job_id", F.lit("cleaned").alias("object_kind"), F.col("cleaned").alias("content")).filter("content is not null")
        reports = done.select("job_id", F.lit("report.json").alias("object_kind"), F.col("report").cast("binary").alias("content")).filter("content is not null")
        write_objects(cleaned.unionByName(reports), f"{out}/objects/batch={batch}", "overwrite")
        done.drop("cleaned", "report").write.mode("overwrite").parquet(f"{out}/results/batch={batch}")
        done.unpersist()

    writer = rows.writeStream.option("checkpointLocation", state).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


__all__ = ["claims", "clean_arrivals", "dedup", "job_events", "rate_limit", "run_to_end", "step"]
