"""Queries on package parts as rows of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parts as px
from ..operators import packages
from .registry import query, quoted, table

PARTS = ("[Content_Types].xml", "_rels/.rels", "word/document.xml", "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml")
#: Further parts, each where the id is divisible.
EXTRA = (("word/c2pa.bin", 3), ("customXml/ContentCredentials/item1.xml", 5), ("word/media/image.C2PA", 7), ("word/c2panel/x.xml", 11))


def part_names(spark, sf_dir):
    k = F.col("doc_id")
    all_parts = F.concat(F.array(*[F.when((k % 9 == 0) & F.lit(p == px.BODY_PART), F.lit(None).cast("string")).otherwise(p) for p in PARTS]), F.array(*[F.when(k % n == 0, p) for p, n in EXTRA]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(all_parts)).alias("part"))


_FIXED = "[" + ", ".join(quoted(p) for p in PARTS) + "]"
PART_SQL = f"""parts as (select doc_id, unnest({_FIXED}) as part from documents union all """ + " union all ".join(f"select doc_id, {quoted(p)} from documents where doc_id % {n} = 0" for p, n in EXTRA) + ")"
BODY = f"(doc_id % 9 <> 0 or part <> {quoted(px.BODY_PART)})"
PROV = f"regexp_matches(part, {quoted(px.PROVENANCE)})"


@query(f"with {PART_SQL} select doc_id, part, {PROV} as dropped from parts where {BODY}")
def part_provenance_filter(spark, sf_dir):
    return part_names(spark, sf_dir).select("doc_id", "part", px.is_provenance(F.col("part")).alias("dropped"))


@query(f"with {PART_SQL} select doc_id, bool_or(part = {quoted(px.BODY_PART)}) as has_body from parts where {BODY} group by doc_id")
def package_has_body(spark, sf_dir):
    return part_names(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(F.col("part") == px.BODY_PART).alias("has_body"))


TARGETS = ("styles.xml", "c2pa.bin", "../word/c2pa.bin", "media/image.C2PA", "theme/theme1.xml", "item1.xml")


@query(
    f"""with {PART_SQL}, refs as (select doc_id, unnest([{', '.join(quoted(t) for t in TARGETS)}]) as target from documents), gone as (select doc_id, regexp_extract(part, '[^/]*$') as base from parts where {PROV})
    select doc_id, target from refs r where not exists (select 1 from gone g where g.doc_id = r.doc_id and ends_with(r.target, g.base))"""
)
def reference_antijoin(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    gone = part_names(spark, sf_dir).filter(px.is_provenance(F.col("part"))).select("doc_id", F.regexp_extract("part", "([^/]*)$", 1).alias("base"))
    return packages.dangling_free(refs, gone, "doc_id")


_PLAIN = "regexp_replace(coalesce(text, ''), '[<>&\"]', ' ', 'g')"


def _xml(spark, sf_dir, build):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), '[<>&"]', " ")
    return table(spark, sf_dir, "documents").select("doc_id", build(text, F.col("doc_id")).alias("xml"))


def _core(t, k):
    return F.concat(
        F.lit('<cp:coreProperties><dc:title>'), t, F.lit('</dc:title><dc:creator>'), t, F.lit('</dc:creator>\n<cp:lastModifiedBy/><cp:revision>'), k.cast("string"), F.lit('</cp:revision>'),
        F.when(k % 7 == 0, '<cp:category a="1"/><dc:language>en</dc:language><cp:category>x</cp:category>').otherwise('<cp:category a="1"/>'),
        F.when(k % 3 == 0, '<dcterms:created xsi:type="dcterms:W3CDTF">2024-01-01T00:00:00Z</dcterms:created>').otherwise(""), F.lit("</cp:coreProperties>"),
    )


_CORE = f"""'<cp:coreProperties><dc:title>' || {_PLAIN} || '</dc:title><dc:creator>' || {_PLAIN} || '</dc:creator>' || chr(10) || '<cp:lastModifiedBy/><cp:revision>' || doc_id || '</cp:revision>'
  || case when doc_id % 7 = 0 then '<cp:category a="1"/><dc:language>en</dc:language><cp:category>x</cp:category>' else '<cp:category a="1"/>' end
  || case when doc_id % 3 = 0 then '<dcterms:created xsi:type="dcterms:W3CDTF">2024-01-01T00:00:00Z</dcterms:created>' else '' end || '</cp:coreProperties>'"""


def _app(t, k):
    return F.concat(F.lit("<Properties><Application>"), t, F.lit("</Application><Pages>"), k.cast("string"), F.lit("</Pages>"), F.when(k % 2 == 0, "<Company>c</Company><TotalTime/>").otherwise("<ApplicationX>1</ApplicationX>"), F.lit("</Properties>"))


_APP = f"""'<Properties><Application>' || {_PLAIN} || '</Application><Pages>' || doc_id || '</Pages>' || case when doc_id % 2 = 0 then '<Company>c</Company><TotalTime/>' else '<ApplicationX>1</ApplicationX>' end || '</Properties>'"""


def _drop_sql(source: str, tags) -> str:
    inner = f"(select doc_id, {source} as x, 0 as n from documents)"
    for tag in tags:
        inner = f"(select doc_id, y as x, n + cast(x <> y as integer) as n from (select *, regexp_replace(x, {quoted(px.element(tag))}, '', 'g') as y from {inner}))"
    return f"select doc_id, x as xml, n as n_dropped from {inner}"


@query(_drop_sql(_CORE, px.CORE_DROP))
def core_props_drop(spark, sf_dir):
    return packages.drop_elements(_xml(spark, sf_dir, _core), "xml", px.CORE_DROP).select("doc_id", "xml", "n_dropped")


@query(_drop_sql(_APP, px.APP_DROP))
def app_props_drop(spark, sf_dir):
    return packages.drop_elements(_xml(spark, sf_dir, _app), "xml", px.APP_DROP).select("doc_id", "xml", "n_dropped")


PROPERTIES = ("AIGenerated", "ProjectEmail", "generator", "Chairman", "content_credentials", "ContentCredentials", "Maintainer", "myGPTModel", "trainAi", "Email", "x-open-ai", "Water Mark", "C2PAClaim", "")


def _custom(t, k):
    name = lambda shift: F.element_at(F.array(*map(F.lit, PROPERTIES)), ((k + shift) % len(PROPERTIES) + 1).cast("int"))
    block = lambda shift: F.concat(F.lit('<property fmtid="{D5}" pid="2" name="'), name(shift), F.lit('"><vt:lpwstr>'), t, F.lit("</vt:lpwstr></property>"))
    return F.concat(F.lit("<Properties>"), block(0), F.lit("\n "), block(5), F.lit('<property pid="3"><vt:i4>1</vt:i4></property></Properties>'))


def _words_sql(name: str) -> str:
    for pattern, to in px.SPLITS:
        name = f"regexp_replace({name}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return f"list_filter(string_split_regex(lower({name}), '[^a-z0-9]+'), lambda w: w <> '')"


_KNOWN = "[" + ", ".join(quoted(w) for w in px.PROPERTY_WORDS) + "]"


def flagged_sql(words: str) -> str:
    return f"(list_has_any({words}, {_KNOWN}) or list_has_any(list_transform(range(1, greatest(len({words}), 1)), lambda i: {words}[i] || {words}[i + 1]), {_KNOWN}))"


_NAMES = "[" + ", ".join(quoted(p) for p in PROPERTIES) + "]"


def _block_sql(shift: int) -> str:
    return f"""'<property fmtid="{{D5}}" pid="2" name="' || ({_NAMES})[(doc_id + {shift}) % {len(PROPERTIES)} + 1] || '"><vt:lpwstr>' || {_PLAIN} || '</vt:lpwstr></property>'"""


_CUSTOM = f"""select doc_id, '<Properties>' || {_block_sql(0)} || chr(10) || ' ' || {_block_sql(5)} || '<property pid="3"><vt:i4>1</vt:i4></property></Properties>' as xml from documents"""


@query(
    f"""with c as ({_CUSTOM}), b as (select doc_id, xml, i, regexp_extract_all(xml, {quoted(px.BLOCK)})[i] as block, string_split_regex(xml, {quoted(px.BLOCK)})[i] as between
      from c, lateral (select unnest(range(1, len(string_split_regex(xml, {quoted(px.BLOCK)})) + 1)) as i)),
    w as (select *, {_words_sql(f"regexp_extract(block, {quoted(px.BLOCK_NAME)}, 1)")} as words from b)
    select doc_id, string_agg(between || case when block is null or {flagged_sql('words')} then '' else block end, '' order by i) as xml from w group by doc_id"""
)
def custom_props_drop(spark, sf_dir):
    return _xml(spark, sf_dir, _custom).select("doc_id", px.drop_custom(F.col("xml")).alias("xml"))


@query(f"with n as (select unnest({_NAMES}) as name), w as (select name, {_words_sql('name')} as words from n) select name, {flagged_sql('words')} as flagged from w")
def property_name_match(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PROPERTIES], "name string").select("name", px.property_flagged(F.col("name")).alias("flagged"))


@query("select doc_id, doc_id % 5 in (0, 1, 2) as is_zip from documents")
def zip_magic(spark, sf_dir):
    k = F.col("doc_id")
    head = F.when(k % 5 == 0, "504B0304").when(k % 5 == 1, "504B0506").when(k % 5 == 2, "504B0708").when(k % 5 == 3, "504B03").otherwise("D0CF11E0")
    data = F.concat(F.unhex(head), F.when(k % 5 == 3, F.unhex(F.lit(""))).otherwise(F.col("text").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", px.zip_magic(data).alias("is_zip"))
