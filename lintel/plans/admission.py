"""Queries on file names and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as fx
from ..functions import text as tx
from .registry import query, quoted, table

SUFFIXES = (".txt", ".MD", ".html", ".docx", ".pdf", ".exe", ".zip", ".PNG", "", ".")
TYPES = ("text/plain; charset=utf-8", "\tApplication/X-MSDownload \u00a0; q=1", None, "application/pdf")
CAP = 5000


def names(spark, sf_dir):
    """documents as uploaded files: name, content_type, size."""
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "a/b/").when(k % 3 == 1, "c\\d\\").otherwise("")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (k % 10 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("file <é> "), k.cast("string"), suffix).alias("name"), kind.alias("content_type"), F.when(k % 11 == 0, 0).otherwise(F.col("n_chars")).alias("size"))


_LIST = "[" + ", ".join(quoted(x) for x in SUFFIXES) + "]"
_TYPES = "[" + ", ".join("null" if x is None else quoted(x) for x in TYPES) + "]"
NAMES = f"""names as (select doc_id, case doc_id % 3 when 0 then 'a/b/' when 1 then 'c\\d\\' else '' end || 'file <é> ' || doc_id || ({_LIST})[doc_id % 10 + 1] as name,
  ({_TYPES})[doc_id % 4 + 1] as content_type, case when doc_id % 11 = 0 then 0 else n_chars end as size from documents)"""


def ext_sql(name: str) -> str:
    return f"lower(regexp_extract({name}, {quoted(fx.EXTENSION)}, 1))"


def _in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


ADMIT = f"""admitted as (select *, case when size <= 0 then 'empty_file' when size > {CAP} then 'file_too_large' when ext = '' then 'missing_extension' when ext in {_in(fx.BLOCKED)} then 'extension_blocked'
  when ext not in {_in(fx.ALLOWED)} then 'extension_not_allowed' when trim(split_part(lower(content_type), ';', 1), ' ' || chr(9) || chr(160)) in {_in(fx.BLOCKED_TYPES)} then 'content_type_blocked' else 'ok' end as code
  from (select *, {ext_sql('name')} as ext from names))"""


@query(f"with {NAMES} select doc_id, name, {ext_sql('name')} as ext from names")
def extension_of(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", "name", fx.extension_of(F.col("name")).alias("ext"))


@query(f"with {NAMES}, {ADMIT} select code, case code when 'ok' then 200 when 'file_too_large' then 413 else 400 end as status, count(*) as n from admitted group by all")
def admission_gate(spark, sf_dir):
    code = fx.admission(F.col("name"), F.col("content_type"), F.col("size"), CAP)
    return names(spark, sf_dir).select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n")).select("code", fx.admission_status(F.col("code")).alias("status"), "n")


@query(
    f"""with {NAMES}, {ADMIT} select case when ext in {_in(fx.TEXT_EXTENSIONS)} then 'worker-layer-a' when ext = 'docx' then 'worker-ooxml' else 'remote-cleaner' end as backend, count(*) as n
    from admitted where code = 'ok' group by 1"""
)
def route_backend(spark, sf_dir):
    ok = names(spark, sf_dir).filter(fx.admission(F.col("name"), F.col("content_type"), F.col("size"), CAP) == "ok")
    return ok.groupBy(fx.backend(fx.extension_of(F.col("name"))).alias("backend")).agg(F.count("*").alias("n"))


@query(
    f"""with i as (select doc_id, case doc_id % 4 when 0 then printf('%08x-1111-4111-8111-%012x', doc_id, doc_id) when 1 then upper(printf('%08x-abcd-4111-8111-%012x', doc_id, doc_id))
    when 2 then '../etc/passwd' else printf('%08x-1111-4111-8111-%011x', doc_id, doc_id) end || case when doc_id % 8 = 0 then chr(10) else '' end as id from documents)
    select doc_id, id, length(id) = 36 and regexp_full_match(lower(replace(id, '-', '')), '[0-9a-f]{{32}}') and [length(x) for x in string_split(id, '-')] = [8, 4, 4, 4, 12] as valid from i"""
)
def job_id_valid(spark, sf_dir):
    k = F.col("doc_id")
    job = F.when(k % 4 == 0, F.format_string("%08x-1111-4111-8111-%012x", k, k)).when(k % 4 == 1, F.upper(F.format_string("%08x-abcd-4111-8111-%012x", k, k))).when(k % 4 == 2, "../etc/passwd").otherwise(F.format_string("%08x-1111-4111-8111-%011x", k, k))
    job = F.concat(job, F.when(k % 8 == 0, "\n").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", job.alias("id")).select("doc_id", "id", fx.job_id_valid(F.col("id")).alias("valid"))


@query(
    "select doc_id, 'uploads/' || doc_id || '/original' as original_key, 'uploads/' || doc_id || '/cleaned' as cleaned_key, 'uploads/' || doc_id || '/report.json' as report_key, "
    "'uploads/' || doc_id || '/meta.json' as meta_key from documents"
)
def object_keys(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", *[fx.object_key(k, kind).alias(f"{name}_key") for name, kind in (("original", "original"), ("cleaned", "cleaned"), ("report", "report.json"), ("meta", "meta.json"))])


RAW = ("5000", "0", "-3", "abc", "", " 7 ", "12.5", "1e3", ".5", "Infinity", "33554432", "1e999", "\t9\n", "8\u2003", None)


@query(
    f"""with r(raw) as (values {', '.join('(null)' if x is None else '(' + quoted(x).replace(chr(9), chr(39) + ' || chr(9) || ' + chr(39)).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + ')' for x in RAW)}), v as (select raw, case when regexp_matches(t, {quoted(fx.NUMBER)}) then try_cast(t as double) end as d from (select raw, trim(raw, ' ' || chr(9) || chr(10) || chr(8195)) as t from r))
    select raw, case when d > 0 and d < 'infinity'::double then d else {float(fx.MAX_BYTES)}::double end as value from v"""
)
def parse_positive(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in RAW], "raw string")
    return rows.select("raw", fx.parse_positive(F.col("raw"), fx.MAX_BYTES).alias("value"))


@query(
    f"""with {NAMES}, b as (select doc_id, name, substring(regexp_replace(regexp_extract(name, {quoted(fx.LAST_SEGMENT)}, 1), {quoted(fx.NAME_RUNS)}, '_', 'g'), 1, 180) as base, {ext_sql('name')} as own from names),
    e as (select *, {ext_sql('base')} as ext, case when own = '' then 'bin' else own end as fallback from b)
    select doc_id, name, case when base = '' or starts_with(base, '.') then 'cleaned.' || fallback when ext = '' then base || '.cleaned.' || fallback
    else regexp_replace(base, '\\.[^.]*$', '') || '.cleaned.' || ext end as download from e"""
)
def download_name(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", "name", fx.download_name(F.col("name")).alias("download"))


@query(
    """with s as (select doc_id, n_chars * (doc_id % 900 + 1) as n from documents) select doc_id, case when n < 1024 then n || ' B' when n < 1048576
    then ((n * 20 + 1024) // 2048) // 10 || '.' || ((n * 20 + 1024) // 2048) % 10 || ' KiB' else ((n * 20 + 1048576) // 2097152) // 10 || '.' || ((n * 20 + 1048576) // 2097152) % 10 || ' MiB' end as label from s"""
)
def format_size(spark, sf_dir):
    n = F.col("n_chars") * (F.col("doc_id") % 900 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", fx.format_size(n).alias("label"))


@query(f"with {NAMES} select doc_id, size * 9000 > {fx.MAX_BYTES} + 1048576 as too_large from names")
def header_too_large(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", fx.header_too_large(F.col("size") * 9000).alias("too_large"))


@query("select doc_id, replace(replace(replace(text, 'e ', 'e' || chr(160)), 'n ', 'n' || chr(8239)), 's ', 's' || chr(12288)) <> text as had, sha256(text) as digest from documents")
def spaces_normalized(spark, sf_dir):
    """Texts with spaces of other widths put in, which normalising takes out again."""
    text = F.col("text")
    odd = F.replace(F.replace(F.replace(text, F.lit("e "), F.lit("e\u00a0")), F.lit("n "), F.lit("n\u202f")), F.lit("s "), F.lit("s\u3000"))
    return table(spark, sf_dir, "documents").select("doc_id", (odd != text).alias("had"), F.sha2(tx.normalize_spaces(odd), 256).alias("digest"))
