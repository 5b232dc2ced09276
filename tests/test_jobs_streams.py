import json

import pytest
from pyspark.sql import functions as F

from lintel import sources, streaming
from lintel.operators import jobs as jb
from lintel.operators import process, reports


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, attempts int, updated_at long")


def test_claim(spark):
    now = 1_000_000
    rows = [("q", "queued", 0, 0), ("e", "error", 1, now), ("d", "done", 1, 0), ("at", "processing", 1, now - 45_000), ("old", "processing", 1, now - 45_001)]
    got = {r["id"]: (r["status"], r["attempts"], r["updated_at"], r["claimed"]) for r in jb.claim(jobs(spark, rows), F.lit(now)).collect()}
    assert got == {"q": ("processing", 1, now, True), "e": ("processing", 2, now, True), "d": ("done", 1, 0, False), "at": ("processing", 1, now - 45_000, False), "old": ("processing", 2, now, True)}


def test_finish_nulls_what_is_missing(spark):
    df = spark.createDataFrame([("a", "processing", "x", 5, "s", 1), ("b", "processing", None, None, None, 1)], "id string, status string, error string, cleaned_size_bytes long, report_summary string, updated_at long")
    res = spark.createDataFrame([("a", "error", "boom", None, None)], "id string, status string, error string, cleaned_size_bytes long, report_summary string")
    got = {r["id"]: (r["status"], r["error"], r["cleaned_size_bytes"], r["report_summary"], r["updated_at"]) for r in jb.finish(df, res, F.lit(9)).collect()}
    assert got == {"a": ("error", "boom", None, None, 9), "b": ("processing", None, None, None, 1)}


def test_latest_ties_and_keys(spark):
    log = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, 1, 1, "c")], "k long, ts long, e long, status string")
    assert {r[0]: r["status"] for r in jb.latest(log, "k", ["ts", "e"], ["status"]).collect()} == {1: "b", 2: "c"}
    keyed = spark.createDataFrame([("x", 2, 1), ("x", 1, 2), (None, 1, 3), (None, 1, 4)], "key string, ts long, e long")
    assert sorted(r["e"] for r in jb.first_by_key(keyed, "key", ["ts", "e"]).collect()) == [2, 3, 4]


def test_broken_states(spark):
    df = spark.createDataFrame([("a", "queued", "n"), ("b", "odd", "n"), (None, "done", "n"), ("c", None, "n"), ("d", "done", None)], "id string, status string, original_name string")
    assert jb.broken_states(df).count() == 4


@pytest.mark.parametrize("keys", [1, 3])
def test_sliding_over_slots(spark, keys):
    """Windows that reach over the edge of an hour count what is before it, once."""
    rows = [(i, i % keys, (3600 * 2 - 90 + i * 7) * 1_000_000) for i in range(40)]
    df = spark.createDataFrame(rows, "e long, k long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["e"]: r["n"] for r in jb.rate_limit_sliding(df, "k", "ts", 3).collect()}
    assert got == {e: sum(1 for _, k2, u2 in rows if k2 == k and u - 60_000_000 < u2 <= u) for e, k, u in rows}


def test_summary(spark):
    report = '{"removedCount":2,"layer":"A","secret":1,"backend":null,"removed":{"U+200B":2},"actions":["a\\"b"]}'
    df = spark.createDataFrame([("text", report), ('k"\\', "not json"), ("x", None)], "k string, r string")
    got = [json.loads(r[0]) for r in df.select(reports.summary_json(F.col("k"), F.col("r"))).collect()]
    assert got[0] == {"kind": "text", "note": got[0]["note"], "removedCount": 2, "layer": "A", "backend": None, "removed": {"U+200B": 2}, "actions": ['a"b']}
    assert "not certified" in got[0]["note"] and got[1]["kind"] == 'k"\\' and set(got[2]) == {"kind", "note"}


def test_public_view(spark):
    cols = "id string, status string, original_name string, content_type string, extension string, size_bytes long, cleaned_size_bytes long, error string, report_summary string, attempts int, created_at long, updated_at long"
    df = spark.createDataFrame([("a", "done", "n", None, "txt", 1, 1, None, '{"kind":"text"}', 1, 0, 0), ("b", "error", "n", None, "txt", 1, None, "e", None, 1, 0, 0), ("c", "queued", "n", None, "txt", 1, None, None, "raw text", 0, 0, 0)], cols)
    got = {r["id"]: r for r in jb.public_view(df).withColumn("s", F.to_json("reportSummary")).collect()}
    assert got["a"]["download"] == "/api/jobs/a/download" and got["a"]["s"] == '{"kind":"text"}' and got["b"]["s"] is None and got["b"]["download"] is None and "raw text" in got["c"]["s"]


def test_remote_retries(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"x"), "a.pdf", "application/pdf"), (2, bytearray(b"x"), "gone.pdf", None), (3, bytearray(b"x"), "bad.pdf", None)], "job_id long, content binary, name string, content_type string")

    def transport(data, name):
        if name == "gone.pdf":
            raise OSError("refused")
        if name == "bad.pdf":
            return 422, '{"error": "no"}'
        return 200, '{"cleaned": "Qg==", "kind": "pdf", "report": {"removedCount": 1}}'

    got = {r["job_id"]: r for r in process.call_remote(df, transport, first_ms=1).collect()}
    assert (bytes(got[1]["cleaned"]), got[1]["kind"], got[1]["attempts"]) == (b"B", "pdf", 1)
    assert got[2]["error"] == "cleaner_unreachable: refused" and got[2]["attempts"] == 3 and got[3]["attempts"] == 1
    done = {r["job_id"]: r["status"] for r in process.process_files(df.limit(1), transport).collect()}
    assert done == {1: "done"}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.TXT").write_bytes("a​".encode())
    files = sources.read_files(spark, str(tmp_path / "in"))
    assert [(r["name"], r["extension"], r["size"]) for r in files.collect()] == [("A.TXT", "txt", 4)]
    objects = files.select(F.lit(1).alias("job_id"), F.lit("original").alias("object_kind"), "content")
    sources.write_objects(objects.unionByName(objects.withColumn("object_kind", F.lit("cleaned"))), str(tmp_path / "objects"))
    read = sources.read_objects(spark, str(tmp_path / "objects"), "cleaned")
    assert read.count() == 1 and "PartitionFilters: [isnotnull(object_kind" in read._jdf.queryExecution().executedPlan().toString()
    both = sources.with_objects(spark.createDataFrame([(1,), (2,)], "job_id int"), read)
    assert both.filter("content is null").count() == 1
    log = spark.createDataFrame([(5, "job_done", "j", None)], "ts long, msg string, jobId string, error string")
    sources.write_log(log, str(tmp_path / "log"))
    assert sources.read_log(spark, str(tmp_path / "log")).first()["jobId"] == "j"


def events(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(path)


def test_transitions():
    step, run = streaming.step, lambda *e: __import__("functools").reduce(lambda s, x: streaming.step(s, *x), e, None)
    assert run(("queued", 0)) == ("queued", 0, 0)
    assert run(("queued", 0), ("processing", 1), ("processing", 2)) == ("processing", 1, 1)
    assert run(("queued", 0), ("processing", 1), ("processing", 45_001)) == ("processing", 1, 1)
    assert run(("queued", 0), ("processing", 1), ("processing", 45_002)) == ("processing", 2, 45_002)
    assert run(("queued", 0), ("processing", 1), ("error", 2), ("processing", 3), ("done", 4), ("processing", 5), ("error", 6)) == ("done", 2, 4)
    assert step(None, "done", 3) == ("queued", 0, 3)


def test_streams_over_batches_with_late_rows(spark, tmp_path):
    at = str(tmp_path / "events.parquet")
    events(spark, [(1, 1, "a", 100), (2, 1, "a", 110), (3, 2, "a", 100_000)], at)
    stream = streaming.job_events(spark, str(tmp_path)).select(F.col("user_id").alias("job_id"), "event_id", F.unix_millis("ts").alias("ts_ms"), F.lit("queued").alias("status"))
    got = streaming.run_to_end(streaming.claims(stream), "update", f"file://{tmp_path}/s1")
    assert {r["job_id"]: r["status"] for r in got.collect()} == {1: "queued", 2: "queued"}
    limited = streaming.run_to_end(streaming.rate_limit(streaming.job_events(spark, str(tmp_path)), "user_id", "ts").select("user_id", F.col("window.start").alias("start"), "n"), "append", f"file://{tmp_path}/s2")
    assert [(r["user_id"], r["n"]) for r in limited.collect()] == [(1, 2)]  # the watermark closed it; the last window stays open


def test_files_are_cleaned_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("a\u200bb".encode())
    (folder / "b.txt").write_bytes(b"\xff")
    (folder / "c.pdf").write_bytes(b"%PDF")
    at = [f"file://{tmp_path}/{x}" for x in ("in", "out", "state")]
    streaming.clean_arrivals(spark, *at).awaitTermination()
    (folder / "d.md").write_bytes(b"plain")
    streaming.clean_arrivals(spark, *at).awaitTermination()
    rows = {r["job_id"].rpartition("/")[2]: (r["status"], r["error"]) for r in spark.read.parquet(f"{at[1]}/results").collect()}
    assert rows == {"a.txt": ("done", None), "b.txt": ("error", "invalid_utf8: Layer A expects UTF-8 text"), "c.pdf": ("error", "cleaner_unconfigured"), "d.md": ("done", None)}
    kept = sources.read_objects(spark, f"{at[1]}/objects", "cleaned")
    assert sorted(bytes(r["content"]) for r in kept.collect()) == [b"ab", b"plain"]
