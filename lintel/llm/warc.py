"""WARC archives: writing with revisit records, reading, and transaction assembly.

Archives are .warc.gz files, a gzip member per record. A capture is a response (or revisit), a request and a metadata record; the latter two name the
first by WARC-Concurrent-To, and assembly joins them again into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, fresh_path, materialize, release, spread, table, tune

#: An archive is closed once it holds so many bytes before compression; one record may be larger.
ROLL_BYTES = 16 << 20
#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(map(str, parts)).encode()).digest()[:16])}>"


def _record(kind: str, rid: str, block: bytes, **more) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    head += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None and k != "content_type"]
    head += [f"Content-Type: {more['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _zip(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _write(folder: str, roll: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        stem = f"{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        seq, buf, plain, n, used = 0, io.BytesIO(), 0, 0, set()

        def close():
            name = f"{root}/{stem}-{seq:05d}.warc.gz"
            with store.open_output_stream(name, compression=None) as f:
                f.write(buf.getvalue())
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{stem}-{seq:05d}.warc.gz", "records": n, "bytes": buf.tell()}], schema=_MANIFEST)

        def put(record):
            nonlocal plain, n
            buf.write(_zip(record))
            plain += len(record)
            n += 1

        for batch in batches:
            for part in byte_slices(batch, "payload"):
                for page_id, url, payload, digest, target in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "target"))):
                    if not n:
                        put(_record("warcinfo", record_id("info", stem, seq), b"software: lintel\r\nformat: WARC File Format 1.1\r\n", content_type="application/warc-fields"))
                    revisit = target is not None and page_id != target
                    rid = record_id("page", page_id, digest)
                    if rid in used or revisit or target is None:
                        rid = record_id("page", page_id, digest, stem, seq, n)
                    used.add(rid)
                    uri = urllib.parse.quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")
                    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    kind = "application/http; msgtype="
                    if revisit:
                        put(_record("revisit", rid, http, Target_URI=uri, Payload_Digest=sha, Profile=PROFILE, Refers_To=record_id("page", target, digest), content_type=kind + "response"))
                    else:
                        put(_record("response", rid, http + payload, Target_URI=uri, Payload_Digest=sha, content_type=kind + "response"))
                    parsed = urllib.parse.urlsplit(uri) if re.match(r"[a-z]+://[^\[\]]*$", uri) else urllib.parse.SplitResult("", "", "/", "", "")
                    ask = f"GET {parsed.path or '/'}{'?' + parsed.query if parsed.query else ''} HTTP/1.1\r\nHost: {parsed.netloc}\r\n\r\n".encode()
                    put(_record("request", record_id("request", stem, seq, n), ask, Target_URI=uri, Concurrent_To=rid, content_type=kind + "request"))
                    put(_record("metadata", record_id("metadata", stem, seq, n), json.dumps({"page_id": page_id, "url": url}).encode(), Target_URI=uri, Concurrent_To=rid, content_type="application/json"))
                    if plain >= roll:
                        yield close()
                        seq, buf, plain, n, used = seq + 1, io.BytesIO(), 0, 0, set()
        if n:
            yield close()
        release()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below `folder`, by default a new one in the shared folder; returns the manifest (archive, records, bytes).

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least 1000 bytes that of the largest page_id is a response and the others
    revisit it; a row without an id revisits one that has an id; where all have none, or a row of the largest id is repeated, these
    are all responses. An empty table gives no archive. A task that is run again writes other files, and the manifest names only those that count.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").select("digest", "target")
    groups = materialize(groups, "copies")
    jobs = rows.join(groups, "digest", "left")
    _make(spark, folder)
    return materialize(jobs.select("page_id", "url", "payload", "digest", "target").mapInArrow(_write(folder, roll_bytes), "archive string, records long, bytes long"), "manifest")


def _make(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


_RECORDS = "archive string, record_id string, type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, http_head string, content string"


def _hex(digest: str | None) -> str | None:
    if not digest:
        return None
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        return digest
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def unzip(data: bytes) -> bytes:
    """All gzip members of an archive. A member is fed in growing pieces, so that what lies behind it is never copied with it."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        z, step = zlib.decompressobj(31), 2048
        while not z.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("truncated gzip member")
            out.append(z.decompress(piece))
            at += len(piece)
            step *= 2
        at -= len(z.unused_data)
    return b"".join(out)


def parse(data: bytes):
    """(headers, block) of each record of a WARC stream; header names in lower case."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("truncated WARC record")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size
    if data[at:].strip():
        raise ValueError(f"no whole WARC record at byte {at}")


def _read(payload: bool):
    names = [x.split()[0] for x in _RECORDS.split(", ")] + ["payload"] * payload
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as f:
                    data = unzip(f.read())
                rows, size = [], 0
                for head, block in parse(data):
                    kind = head["warc-type"]
                    row = dict.fromkeys(names) | {"archive": archive, "record_id": head["warc-record-id"], "type": kind, "target_uri": head.get("warc-target-uri"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "payload_digest": _hex(head.get("warc-payload-digest"))}
                    if "application/http" in head.get("content-type", ""):
                        top, _, body = block.partition(b"\r\n\r\n")
                        row["http_head"] = top.decode("utf-8", "replace")
                        if kind == "response":
                            found = hashlib.sha1(body).hexdigest()
                            if row["payload_digest"] not in (None, found):
                                raise ValueError(f"{row['record_id']}: payload doesn't match its digest")
                            row |= {"payload_digest": found, "payload_bytes": len(body)} | ({"payload": body} if payload else {})
                        elif kind == "revisit":
                            length = re.search(r"(?im)^content-length:\s*(\d+)", row["http_head"])
                            row["payload_bytes"] = int(length[1]) if length else None
                    else:
                        row["content"] = block.decode("utf-8", "replace")
                    rows.append(row)
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        release()

    return run


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """All records of archives (archive: its address), digests verified; `payload` says whether bodies come along."""
    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n).mapInArrow(_read(payload), _RECORDS + ", payload binary" * payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, archive, type, response, request, metadata (an array, in order of record id).

    Requests and metadata meet their response or revisit record by WARC-Concurrent-To within an archive. Those whose response is missing come out
    with a null response; of several requests the one with the least record id counts. Other record types, as warcinfo, are no part of captures.
    """
    body = [c for c in records.columns if c not in ("archive", "concurrent_to", "http_head", "content")]
    main = records.filter(F.col("type").isin("response", "revisit")).select("archive", F.col("record_id").alias("capture_id"), F.struct(*body, "http_head").alias("response"))
    by = ["archive", F.col("concurrent_to").alias("capture_id")]
    asked = records.filter("type = 'request'").groupBy(*by).agg(F.min_by(F.struct("record_id", "http_head"), "record_id").alias("request"))
    told = records.filter("type = 'metadata'").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("record_id", "content"))).alias("metadata"))
    keys = ["archive", "capture_id"]
    return main.join(asked, keys, "full").join(told, keys, "full").withColumn("type", F.col("response.type"))


def captures_of(pages: DataFrame, payload: bool = True) -> DataFrame:
    """Write pages to archives, read them back and assemble: one nested row per page."""
    return assemble(materialize(read_archives(write_archives(pages), payload), "records"))


def op4_warc_transactions(spark, sf_dir):
    tune(spark)
    caps = captures_of(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), payload=False)
    rows = caps.select(
        F.get_json_object(F.col("metadata")[0]["content"], "$.page_id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "capture_id", F.col("response.refers_to").alias("refers_id"),
    )
    rows = materialize(rows, "captures")
    at = rows.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("at_id")).agg(F.max("page_id").alias("refers_to"))
    found = rows.filter("record_type = 'revisit'").join(at, F.col("refers_id") == F.col("at_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rest = rows.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return found.select(*columns).unionByName(rest.select(*columns))


OP4_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as target, count(*) as k from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
  case when k > 1 and target is not null and page_id is distinct from target then 'revisit' else 'response' end as record_type,
  case when k > 1 and page_id is distinct from target then target end as refers_to
from p left join g on p.d = g.d
"""
