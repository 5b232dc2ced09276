"""Queries on text and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scrub
from .registry import INJ, injected, query, quoted, table

CLASS = quoted(tx.STRIP_CLASS)
COUNT = f"len(regexp_extract_all(t, {CLASS}))"
CODES = f"list_transform(regexp_extract_all(t, {CLASS}), lambda c: printf('U+%04X', unicode(c)))"


@query(f"with {INJ} select doc_id, regexp_replace(t, {CLASS}, '', 'g') as cleaned from inj")
def text_strip(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", tx.strip_marks(F.col("t")).alias("cleaned"))


@query(f"with {INJ} select lang, count(*) as docs, cast(sum({COUNT}) as bigint) as removed from inj group by lang")
def text_removed_count(spark, sf_dir):
    return injected(spark, sf_dir, "lang").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(tx.count_marks(F.col("t"))).alias("removed"))


@query(f"with {INJ}, c as (select lang, unnest({CODES}) as code_point from inj) select lang, code_point, count(*) as n from c group by all")
def text_removed_histogram(spark, sf_dir):
    return scrub.mark_histogram(injected(spark, sf_dir, "lang"), ["lang"], "t")


@query(
    f"with {INJ}, c as (select doc_id, {CODES} as l from inj) select doc_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(l)), "
    "lambda x: x || '=' || cast(len(list_filter(l, lambda y: y = x)) as varchar)), ';'), '') as removed from c"
)
def text_removed_map(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", tx.histogram_text(tx.mark_codes(F.col("t"))).alias("removed"))


@query(f"with {INJ} select lang, cast(sum(len(regexp_extract_all(t, chr(8204)))) as bigint) as kept from inj group by lang")
def text_keep_list(spark, sf_dir):
    kept = F.regexp_count(tx.strip_marks(F.col("t")), F.lit("‌"))
    return injected(spark, sf_dir, "lang").groupBy("lang").agg(F.sum(kept).alias("kept"))


@query(f"with {INJ}, c as (select lang, regexp_replace(t, {CLASS}, '', 'g') as t from inj) select lang, cast(sum({COUNT}) as bigint) as residual from c group by lang")
def text_residual(spark, sf_dir):
    return scrub.clean_text(injected(spark, sf_dir, "lang"), "t").groupBy("lang").agg(F.sum("residual").alias("residual"))


@query(f"with {INJ} select doc_id, {COUNT} > 0 as suspicious, cast({COUNT} as integer) as removed_count from inj")
def text_inspect(spark, sf_dir):
    return scrub.inspect_text(injected(spark, sf_dir), "t").select("doc_id", "suspicious", "removed_count")


@query(f"with {INJ} select doc_id, 'text' as kind, 'A' as layer, 'worker-layer-a' as backend, cast({COUNT} as integer) as removed_count, {quoted(tx.NOTE)} as note from inj")
def text_clean_report(spark, sf_dir):
    return scrub.text_reports(injected(spark, sf_dir), "t").select("doc_id", "kind", "layer", "backend", "removed_count", "note")


@query(
    f"with {INJ}, c as (select lang, t, regexp_replace(t, {CLASS}, '', 'g') as cleaned, {COUNT} as n from inj) select lang, count(*) as docs, count(*) filter (where n > 0) as dirty_docs, "
    f"cast(sum(n) as bigint) as removed, cast(sum(length(cleaned)) as bigint) as chars_left, cast(sum(len(regexp_extract_all(cleaned, {CLASS}))) as bigint) as residual from c group by lang"
)
def text_clean_by_lang(spark, sf_dir):
    """The flagship: every document cleaned, counted and checked again, by language."""
    c = scrub.clean_text(injected(spark, sf_dir, "lang"), "t")
    return c.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("removed_count") > 0).alias("dirty_docs"), F.sum("removed_count").alias("removed"),
        F.sum(F.length("cleaned").cast("long")).alias("chars_left"), F.sum("residual").alias("residual"),
    )


@query(f"with {INJ}, c as (select lang, source, {COUNT} as n from inj) select lang, source, count(*) as docs, cast(sum(n) as bigint) as removed from c group by rollup (lang, source)")
def text_dirty_rollup(spark, sf_dir):
    return injected(spark, sf_dir, "lang", "source").withColumn("n", tx.count_marks(F.col("t"))).rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("removed"))


@query(f"with {INJ}, c as (select doc_id, {COUNT} as n from inj) select doc_id, cast(n as integer) as removed_count from c order by n desc, doc_id limit 20")
def text_dirtiest(spark, sf_dir):
    return scrub.inspect_text(injected(spark, sf_dir), "t").select("doc_id", "removed_count").orderBy(F.desc("removed_count"), "doc_id").limit(20)


@query("select doc_id, doc_id % 6 <> 0 as valid from documents")
def utf8_gate(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 6 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.valid_utf8(F.concat(F.col("text").cast("binary"), tail)).alias("valid"))


@query(
    f"with {INJ}, b as (select doc_id, t, doc_id % 6 = 0 as bad from inj) select doc_id, case when bad then 'invalid_utf8: Layer A expects UTF-8 text' end as error, "
    f"case when not bad then cast({COUNT} as integer) end as removed_count, case when not bad then octet_length(encode(regexp_replace(t, {CLASS}, '', 'g'))) end as cleaned_bytes from b"
)
def bytes_clean(spark, sf_dir):
    """The text job on bytes: a leading byte order mark goes uncounted, invalid bytes are an error."""
    data = F.concat(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.col("t").cast("binary"), F.when(F.col("doc_id") % 6 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit(""))))
    return scrub.clean_bytes(injected(spark, sf_dir).select("doc_id", data.alias("content"))).select("doc_id", "error", "removed_count", F.octet_length("cleaned").cast("long").alias("cleaned_bytes"))


@query("select doc_id, base64(encode(text)) as b64, true as same from documents")
def base64_roundtrip(spark, sf_dir):
    b64 = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")
    return table(spark, sf_dir, "documents").select("doc_id", b64.alias("b64"), (F.unbase64(b64).cast("string") == F.col("text")).alias("same"))


@query()
def crc32_parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query(
    f"""with {INJ}, a as (select doc_id, t as x from inj union all select doc_id, lang || case when doc_id % 2 = 0 then chr(8203) else '' end from inj
    union all select doc_id, source || case when doc_id % 3 = 0 then chr(8238) else '' end from inj), c as (select doc_id, unnest({CODES.replace('(t,', '(x,')}) as code_point from a)
    select doc_id, code_point, count(*) as n from c group by all"""
)
def removed_merge(spark, sf_dir):
    inj = injected(spark, sf_dir, "lang", "source")
    two = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "​").otherwise(""))
    three = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "‮").otherwise(""))
    codes = inj.select("doc_id", tx.mark_codes(F.col("t")).alias("a"), tx.mark_codes(two).alias("b"), tx.mark_codes(three).alias("c"))
    return scrub.merge_histograms(codes, "doc_id", ["a", "b", "c"])


@query(r"select doc_id, substring(regexp_replace('failed' || chr(1) || chr(10) || text, '[\x{00}-\x{1F}]', ' ', 'g'), 1, 500) as error from documents")
def error_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_error(F.concat(F.lit("failed\x01\n"), "text")).alias("error"))
