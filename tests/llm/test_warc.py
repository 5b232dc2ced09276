import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lintel.llm import warc

BIG = "x" * 1200
PAGES = [
    (1, "http://a/b c", BIG), (2, None, BIG), (3, "http://a/é?q=1", BIG), (3, "http://a/é?q=1", BIG), (None, "u", BIG), (4, "http://[bad", None), (5, "x", ""), (6, "y", "short"), (7, "y", "short"), (8, "z\r\nEvil: 1", "é" * 600), (9, "w", "é" * 600),
    (10, "w", "WARC/1.1\r\n\r\n" * 100), (11, "q", "a" * 999), (12, "q", "a" * 999), (13, "q", "b" * 3_000_000), (None, None, "c" * 1000), (None, None, "c" * 1000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("target", F.lit(3))


@pytest.mark.parametrize("roll", [1, 16 << 20])
def test_captures(spark, pages, roll):
    manifest = warc.write_archives(pages, roll_bytes=roll)
    assert manifest.count() == (len(PAGES) if roll == 1 else manifest.count())
    caps = warc.assemble(warc.read_archives(manifest)).select("*", F.col("metadata")[0]["content"].alias("meta")).collect()
    assert len(caps) == len(PAGES) and all(len(c["metadata"]) == 1 and c["request"]["http_head"].startswith("GET ") for c in caps)
    got = sorted((c["type"], c["response"]["payload_digest"], c["response"]["payload_bytes"], c["meta"]) for c in caps)
    import json

    def kind(page_id, html):
        same = [p for p, _, h in PAGES if h == html and p is not None]
        return "revisit" if len(html.encode()) >= 1000 and same and page_id != max(same) else "response"

    want = sorted((kind(p, h or ""), hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()), json.dumps({"page_id": p, "url": u})) for p, u, h in PAGES)
    assert got == want
    assert all((bytes(c["response"]["payload"]).decode() in {h or "" for _, _, h in PAGES}) if c["type"] == "response" else c["response"]["payload"] is None for c in caps)
    named = {c["capture_id"] for c in caps if c["type"] == "response"}
    assert all(c["response"]["refers_to"] in named for c in caps if c["type"] == "revisit")


def test_archives_are_plain_gzip(spark, pages):
    for r in warc.write_archives(pages).collect():
        with gzip.open(r["archive"].removeprefix("file://")) as f:
            data = f.read()
        assert len(list(warc.parse(data))) == r["records"] and data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_orphans_stay(spark):
    rows = [("a", "r1", "request", None, "gone", None, None, None, "GET /", None), ("a", "m1", "metadata", None, "gone", None, None, None, None, "{}"), ("a", "m2", "metadata", None, "gone", None, None, None, None, "{}")]
    got = warc.assemble(spark.createDataFrame(rows, warc._RECORDS)).collect()
    assert len(got) == 1 and got[0]["response"] is None and len(got[0]["metadata"]) == 2


def test_damage():
    record = warc._zip(warc._record("response", "<x>", b"y", content_type="text/plain"))
    assert warc.unzip(record * 3).count(b"WARC/1.1") == 3
    with pytest.raises(ValueError):
        warc.unzip(record[:-9])
    with pytest.raises(ValueError):
        list(warc.parse(warc.unzip(record)[:-6]))


def test_empty(spark, pages):
    assert warc.captures_of(pages.limit(0)).collect() == []


def test_query(spark):
    """Over copies, which the small tables lack."""
    df = spark.createDataFrame([(i, "u", f"{i % 3}" * 2000) for i in range(40)], "page_id long, url string, html string")
    import tempfile

    at = tempfile.mkdtemp()
    df.write.parquet(f"{at}/pages.parquet")
    rows = {r["page_id"]: r for r in warc.op4_warc_transactions(spark, at).collect()}
    assert len(rows) == 40
    for i, r in rows.items():
        last = 39 - (39 - i) % 3
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == (("response", None, 2000) if i == last else ("revisit", last, 2000))
