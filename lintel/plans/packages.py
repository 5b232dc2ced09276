"""Queries on whole packages, made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packages
from .registry import RLO, ZWSP, query, table

TYPES_XML = '<Types><Override PartName="/word/document.xml" ContentType="x"/><Override PartName="/word/c2pa.bin" ContentType="y"/></Types>'
RELS_XML = '<Relationships><Relationship Id="r1" Target="document.xml"/><Relationship Id="r2" Target="../word/c2pa.bin"/></Relationships>'
CORE_XML = "<cp:coreProperties><dc:title>t</dc:title><dc:creator>c</dc:creator></cp:coreProperties>"


def _body(text):
    """word/document.xml, with marks behind the text."""
    k = F.col("doc_id")
    return F.concat(F.lit("<w:t>"), text, F.when(k % 2 == 0, ZWSP).otherwise(""), F.when(k % 3 == 0, RLO + RLO).otherwise(""), F.lit("</w:t>"))


def part_rows(spark, sf_dir):
    """doc_id, ordinal, part, data and the other fields of an entry, seven rows a document."""
    body = _body(F.col("text"))
    parts = [("[Content_Types].xml", F.lit(TYPES_XML)), ("_rels/.rels", F.lit(RELS_XML)), ("word/document.xml", body), ("docProps/core.xml", F.lit(CORE_XML)), ("word/c2pa.bin", F.lit("manifest")), ("word/empty.xml", F.lit("")), ("word/media/x.png", F.col("text"))]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(p).alias("part"), d.cast("binary").alias("data")) for i, (p, d) in enumerate(parts)])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    return docs.withColumns({"dos_time": F.lit(0x6000), "dos_date": F.lit(0x5929), "ext_attr": F.lit(0).cast("long"), "stored": F.col("part") == "word/c2pa.bin"})


def made(spark, sf_dir):
    """doc_id and package, without a shuffle: each document's parts are in its own row."""
    body = _body(F.col("text"))
    entry = lambda p, d, stored=False: F.struct(F.lit(p).alias("part"), d.cast("binary").alias("data"), F.lit(0x6000).alias("dos_time"), F.lit(0x5929).alias("dos_date"), F.lit(0).cast("long").alias("ext_attr"), F.lit(stored).alias("stored"))
    entries = F.array(entry("[Content_Types].xml", F.lit(TYPES_XML)), entry("_rels/.rels", F.lit(RELS_XML)), entry("word/document.xml", body), entry("docProps/core.xml", F.lit(CORE_XML)), entry("word/c2pa.bin", F.lit("manifest"), True), entry("word/empty.xml", F.lit("")), entry("word/media/x.png", F.col("text")))
    return packages.implode_entries(table(spark, sf_dir, "documents").select("doc_id", entries.alias("entries")), "doc_id")


_BODY = "'<w:t>' || text || case when doc_id % 2 = 0 then chr(8203) else '' end || case when doc_id % 3 = 0 then chr(8238) || chr(8238) else '' end || '</w:t>'"
_SIZES = f"[{len(TYPES_XML)}, {len(RELS_XML)}, octet_length(encode({_BODY})), {len(CORE_XML)}, 8, 0, octet_length(encode(text))]"
_PARTS = "['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'docProps/core.xml', 'word/c2pa.bin', 'word/empty.xml', 'word/media/x.png']"


@query(f"select doc_id, cast(i as integer) as ordinal, {_PARTS}[i + 1] as part, cast({_SIZES}[i + 1] as integer) as size from documents, (select unnest(range(7)) as i)")
def package_explode(spark, sf_dir):
    return packages.list_packages(made(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "part", "size")


@query("select doc_id, true as same from documents")
def package_roundtrip(spark, sf_dir):
    """Parts to packages to parts, back to the same bytes."""
    rows = part_rows(spark, sf_dir)
    there = packages.implode_packages(rows, "doc_id")
    hashed = lambda df: F.xxhash64("ordinal", "part", "data", "dos_time", "dos_date", "ext_attr").cast("decimal(38,0)")
    back = packages.explode_packages(there, "doc_id").groupBy("doc_id").agg(F.sum(hashed(None)).alias("a"))
    return rows.groupBy("doc_id").agg(F.sum(hashed(None)).alias("b")).join(back, "doc_id", "left").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


@query(
    """select doc_id, cast((case when doc_id % 2 = 0 then 1 else 0 end) + (case when doc_id % 3 = 0 then 2 else 0 end) as integer) as removed_count,
    case when doc_id % 2 = 0 or doc_id % 3 = 0 then 'word/document.xml' else '' end as parts_cleaned, 'removed provenance parts: word/c2pa.bin;stripped from docProps/core.xml: dc:creator' as actions,
    6 as entries, 0 as residual, false as still_has_c2pa from documents"""
)
def package_clean(spark, sf_dir):
    done = packages.clean_packages(made(spark, sf_dir), "doc_id")
    count = F.conv(F.hex(F.expr("substring(cleaned, length(cleaned) - 11, 1)")), 16, 10).cast("int")
    return done.select("doc_id", "removed_count", F.array_join("parts_cleaned", ",").alias("parts_cleaned"), F.array_join("actions", ";").alias("actions"), count.alias("entries"), "residual", "still_has_c2pa")


@query(f"select doc_id, 7 as entries, cast(list_sum({_SIZES}) as bigint) as bytes from documents")
def package_sizes(spark, sf_dir):
    parts = packages.list_packages(made(spark, sf_dir), "doc_id")
    return parts.groupBy("doc_id").agg(F.count("*").cast("int").alias("entries"), F.sum(F.col("size").cast("long")).alias("bytes"))
