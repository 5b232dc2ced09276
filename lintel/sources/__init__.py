"""Where files, objects, bodies and logs come from and go to."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import batches_of, bounded
from ..functions import files as fx

OBJECT_KINDS = ("original", "cleaned", "report.json", "meta.json")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, extension, size and content of files below a folder. Filters on name and size are cheap: content is read last."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", fx.LAST_SEGMENT, 1)
    return rows.select("path", name.alias("name"), fx.extension_of(name).alias("extension"), F.col("length").alias("size"), "content")


def write_objects(objects: DataFrame, path: str, mode: str = "append") -> None:
    """Objects (job_id, object_kind, content and more) as Parquet, in folders by kind: a reader of one kind reads no other."""
    objects.write.mode(mode).partitionBy("object_kind").parquet(path)


def read_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("object_kind") == kind)


def with_objects(jobs: DataFrame, objects: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs with the content of their object; null where it is missing."""
    return jobs.join(objects.select(key, "content"), key, "left")


def write_log(events: DataFrame, path: str) -> None:
    """One JSON line per event, with ts and msg first; null fields are left out."""
    rest = [c for c in events.columns if c not in ("ts", "msg")]
    events.select(F.to_json(F.struct("ts", "msg", *rest)).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str = "ts long, msg string, jobId string, error string, attempt int") -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("e")).select("e.*")


def json_body(body: Column) -> Column:
    """struct(parsed, error) of a JSON body: the error is invalid_json where it can't be read."""
    parsed = F.try_parse_json(body)
    return F.struct(parsed.alias("parsed"), F.when(parsed.isNull(), F.lit("invalid_json")).alias("error"))


def restart_id(body: Column) -> Column:
    """struct(job_id, error): the id that a restart names as jobId, job_id or id; only a UUID-shaped one counts."""
    b = json_body(body)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(b["parsed"], f"$.{k}", "variant")) == "STRING", F.try_variant_get(b["parsed"], f"$.{k}", "string"))
    found = F.coalesce(text("jobId"), text("job_id"), text("id"))
    error = F.coalesce(b["error"], F.when(~fx.job_id_valid(found), "invalid_job_id"))
    return F.struct(F.when(error.isNull(), found).alias("job_id"), error.alias("error"))


_UPLOAD = pa.schema([("name", pa.string()), ("type", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _parameters(value: str) -> dict[str, str]:
    """Parameters of a header, by name in lower case; quoted ones without their quotes."""
    return {k.lower(): quoted if quoted is not None else plain for k, quoted, plain in ((m[1], m[2], m[3]) for m in re.finditer(r';\s*([^=;\s]+)\s*=\s*(?:"([^"]*)"|([^;\s]*))', value))}


def parse_upload(media: str | None, data: bytes | None):
    """(name, type, content, error) of a multipart body's `file` field. Parts are cut out by their boundary, byte by byte as they came, whatever type they name."""
    if not (media or "").strip().lower().startswith("multipart/form-data"):
        return None, None, None, "unsupported_media"
    mark = _parameters(media).get("boundary", "")
    body = b"\r\n" + (data or b"")
    edge = b"\r\n--" + mark.encode()
    at = body.find(edge) if mark else -1
    while at >= 0:
        line = body.find(b"\r\n", at + len(edge))
        if line < 0 or body[at + len(edge) : at + len(edge) + 2] == b"--":
            break
        end = body.find(edge, line)
        if end < 0:
            break
        head, found, content = body[line:end].partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
        told = _parameters(";" + fields.get("content-disposition", "").partition(";")[2])
        if found and told.get("name") == "file" and "filename" in told:
            kind = fields.get("content-type")
            return told["filename"], kind.partition(";")[0].strip().lower() if kind is not None else None, content, None
        at = end
    return None, None, None, "missing_file"


def parse_uploads(df: DataFrame, key: str, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """key, name, type, content and error of multipart bodies with one `file` field."""
    bounded(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def rows(b):
        for k, media, data in zip(*b.columns):
            row = parse_upload(media.as_py(), data.as_py())
            yield dict(zip(["key", *_UPLOAD.names], [k.as_py(), *row])), len(row[2] or b"")

    def run(batches):
        for b in batches:
            yield from batches_of(rows(b), pa.schema([("key", b.schema.field(0).type), *_UPLOAD]))

    return df.select(F.col(key).alias("key"), content_type, body).mapInArrow(run, f"key {kind}, name string, type string, content binary, error string").withColumnRenamed("key", key)


def upload_part(content_type: Column, body: Column) -> Column:
    """struct(name, type, size, error) of a multipart body's file; null for a null body. The file's bytes stay in the worker."""
    kind = pa.struct([("name", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("error", pa.string())])

    def one(media, data):
        name, own, content, error = parse_upload(media, data)
        return {"name": name, "type": own, "size": None if content is None else len(content), "error": error}

    def run(media: pa.Array, bodies: pa.Array) -> pa.Array:
        return pa.array([None if d is None else one(m, d) for m, d in zip(media.to_pylist(), bodies.to_pylist())], kind)

    return F.arrow_udf(run, "name string, type string, size bigint, error string")(content_type, body)


def upload_meta(job_id: Column, name: Column, content_type: Column, size: Column, created_ms: Column) -> Column:
    """The JSON that is kept beside an original."""
    return F.to_json(F.struct(job_id.alias("jobId"), name.alias("originalName"), content_type.alias("contentType"), size.alias("sizeBytes"), created_ms.alias("createdAt")), {"ignoreNullFields": "false"})
