"""Queries on hosts, addresses, origins, routes and replies: literal cases, and the addresses of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net
from ..operators import jobs as jb
from .registry import query, quoted, table

HOSTS = ("127.1.2.3", "127.255.255.254", "localhost", "LocalHost.", "::1", "[::1]", "::ffff:127.9.9.9", "[::ffff:127.9.9.9]", "::ffff:7f09:9", "0:0:0:0:0:ffff:7fff:1", "0.0.0.0", "::", "files.example", "9.9.9.9", "::ffff:9.9.9.9", "127.0.0.300", "::ffff:909:909", "1277.0.0.1", "")


def values(names: str, rows) -> str:
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else quoted(x)
    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


def ip_sql(ip: str) -> str:
    part = lambda k: f"try_cast(regexp_extract({ip}, {quoted(net.IPV4)}, {k}) as integer)"
    return f"coalesce({part(1)} = 127 and {part(2)} <= 255 and {part(3)} <= 255 and {part(4)} <= 255, false)"


def loop_sql(host: str) -> str:
    h = f"regexp_replace(lower({host}), '^\\[|\\]$', '', 'g')"
    word = f"try_cast('0x' || lpad(regexp_extract({h}, {quoted(net.MAPPED_HEX)}, 1), 4, '0') as integer)"
    known = ", ".join(quoted(x) for x in net.LOCAL_HOSTS)
    return f"""(case when {host} is null then false when {h} in ({known}) then true when regexp_matches({h}, {quoted(net.MAPPED_DOTTED)}) then {ip_sql(f"regexp_extract({h}, {quoted(net.MAPPED_DOTTED)}, 1)")}
      when regexp_matches({h}, {quoted(net.MAPPED_HEX)}) then {word} // 256 = 127 else {ip_sql(h)} end)"""


@query(f"select host, {loop_sql('host')} as is_loopback from {values('host', [(h,) for h in HOSTS])}")
def loopback_host(spark, sf_dir):
    return spark.createDataFrame([(h,) for h in HOSTS], "host string").select("host", net.loopback_host(F.col("host")).alias("is_loopback"))


ADDRESSES = (
    *[("production", f"http://{h}/") for h in ("127.9.9.9:9000", "[::ffff:127.9.9.9]:9000", "localhost", "2130706433", "0x7f000001", "0177.0.0.1", "127.1", "127.0.1", "0x7f.1", "256.1.1.1", "1.2.3.4.5", "9.9.9.9", "[0:0:0:0:0:0:0:1]", "me@127.2", "08.1", "4294967296", "files.example")],
    ("development", "http://127.9.9.9:9000/"), ("production", "no address"), ("production", "  https://files.example//  "), ("development", ""), ("production", None), ("development", "http://[::1]:1/"), ("production", "http:// x/"),
)
_URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#\s]+)"
RESOLVE = f"""r as (select *, trim(coalesce(url, '')) as raw, lower(regexp_extract(trim(coalesce(url, '')), '{_URL}', 1)) as h from u),
 n as (select *, string_split(h, '.') as parts, list_transform(string_split(h, '.'), lambda x: case when regexp_full_match(x, '0x[0-9a-f]+') then try_cast(x as bigint)
   when regexp_full_match(x, '0[0-7]+') then cast(list_sum(list_transform(range(length(x)), lambda i: cast(substring(x, cast(i as integer) + 1, 1) as bigint) * pow(8, length(x) - 1 - i))) as bigint)
   when regexp_full_match(x, '0|[1-9][0-9]*') then try_cast(x as bigint) end) as n from r),
 i as (select *, n[-1] + cast(coalesce(list_sum(list_transform(range(len(n) - 1), lambda k: n[k + 1] * pow(256, 3 - k))), 0) as bigint) as ip from n),
 q as (select *, case when regexp_full_match(h, '\\[[0:]*:0*1\\]') then '::1' when h like '%:%' or not regexp_full_match(parts[-1], '[0-9]+|0x[0-9a-f]*') then h
   when len(n) <= 4 and list_count(n) = len(n) and coalesce(list_max(n[:-2]), 0) <= 255 and n[-1] < pow(256, 5 - len(n)) then concat_ws('.', ip // 16777216, ip // 65536 % 256, ip // 256 % 256, ip % 256) end as host from i),
 w as (select *, case when raw = '' then null when h = '' or host is null then 'invalid_cleaner_url' when {loop_sql('host')} and environment = 'production' then 'loopback_unreachable_in_production' end as reason from q),
 x as (select *, case when raw <> '' and reason is null then regexp_replace(raw, '/$', '') end as resolved from w)"""


@query(f"with u as {values('environment, url', ADDRESSES)}, {RESOLVE} select environment, url, resolved, reason from x")
def resolve_url(spark, sf_dir):
    rows = spark.createDataFrame(list(ADDRESSES), "environment string, url string")
    return rows.withColumn("r", net.resolve_url(F.col("environment"), F.col("url"))).select("environment", "url", "r.resolved", "r.reason")


_ORIGIN = f"lower(regexp_extract(url, {quoted(net.ORIGIN)}, 1))"
ALLOWED_ORIGIN = "https://app.example"


@query(f"with o as (select page_id, {_ORIGIN} as own, case page_id % 4 when 0 then {_ORIGIN} when 1 then '{ALLOWED_ORIGIN}' when 2 then 'https://evil.example' end as origin from pages) select page_id, case when origin = own or origin = '{ALLOWED_ORIGIN}' then origin end as allowed from o")
def cors_decision(spark, sf_dir):
    k = F.col("page_id")
    origin = F.when(k % 4 == 0, net.origin_of(F.col("url"))).when(k % 4 == 1, ALLOWED_ORIGIN).when(k % 4 == 2, "https://evil.example")
    return table(spark, sf_dir, "pages").select("page_id", net.cors_origin(F.col("url"), origin, F.lit(ALLOWED_ORIGIN)).alias("allowed"))


@query(
    f"""with u as {values('environment, url', ADDRESSES)}, {RESOLVE}, b as (select unnest([true, false]) as bound) select environment, url, bound, bound or resolved is not null as available from x, b"""
)
def remote_available(spark, sf_dir):
    rows = spark.createDataFrame([(e, u, b) for e, u in ADDRESSES for b in (True, False)], "environment string, url string, bound boolean")
    return rows.select("environment", "url", "bound", net.remote_available(F.col("bound"), F.col("environment"), F.col("url")).alias("available"))


@query(
    f"""with o as (select page_id, {_ORIGIN} as own, case page_id % 3 when 0 then {_ORIGIN} when 1 then 'https://evil.example' end as origin from pages)
    select page_id, case when origin = own then origin end as allow_origin, case when origin = own then 'GET,POST,OPTIONS' end as allow_methods, case when origin = own then 3 else 0 end + case when origin = own then 1 else 0 end as n_headers from o"""
)
def preflight_headers(spark, sf_dir):
    k = F.col("page_id")
    origin = F.when(k % 3 == 0, net.origin_of(F.col("url"))).when(k % 3 == 1, "https://evil.example")
    headers = net.reply_headers(net.cors_origin(F.col("url"), origin, F.lit("")))
    rows = table(spark, sf_dir, "pages").select("page_id", headers.alias("h"))
    return rows.select("page_id", F.col("h")["access-control-allow-origin"].alias("allow_origin"), F.col("h")["access-control-allow-methods"].alias("allow_methods"), F.size("h").alias("n_headers"))


PATHS = ("/api/health", "/api/upload", "/api/jobs", "/api/clean", "/api/jobs/x1", "/api/jobs/x1/download", "/api/jobs/x1/report", "/api/jobs/x1/other", "/api/jobs/", "/")


@query(
    f"""with c as (select method, path from {values('path', [(p,) for p in PATHS])}, (select unnest(['GET', 'POST', 'DELETE']) as method)) select method, path, case when path = '/api/health' and method = 'GET' then 'health'
    when path = '/api/upload' and method = 'POST' then 'upload' when path in ('/api/jobs', '/api/clean') and method = 'POST' then 'start_job' when path = '/api/jobs/x1/download' and method = 'GET' then 'download'
    when path = '/api/jobs/x1/report' and method = 'GET' then 'job_report' when path = '/api/jobs/x1' and method = 'GET' then 'job_status' else 'not_found' end as handler from c"""
)
def route_match(spark, sf_dir):
    rows = spark.createDataFrame([(m, p) for m in ("GET", "POST", "DELETE") for p in PATHS], "method string, path string")
    return rows.select("method", "path", net.route(F.col("method"), F.col("path")).alias("handler"))


BEARERS = (("1", None, None), ("2", "Bearer abc", None), ("3", None, "k"), ("4", "bearer  k", " k "), ("5", "Bearer x", "k"), ("6", "Basic k", "k"), ("7", "", ""))


@query(f"select case_id, coalesce(trim(key), '') = '' or regexp_extract(coalesce(header, ''), {quoted(net.BEARER)}, 1) = trim(key) as open from {values('case_id, header, key', BEARERS)}")
def bearer_gate(spark, sf_dir):
    return spark.createDataFrame(list(BEARERS), "case_id string, header string, key string").select("case_id", net.bearer_ok(F.col("header"), F.col("key")).alias("open"))


FAILURES = ((500, "x"), (503, "cleaner_unreachable: refused"), (404, "Request Timeout"), (404, "no"), (0, None), (429, None), (400, "UNREACHABLE"), (599, ""))


@query(f"select status, error, status >= 500 or status = 0 or coalesce(regexp_matches(error, '(?i)unreachable|timeout'), false) as retryable from {values('status, error', FAILURES)}")
def retryable(spark, sf_dir):
    return spark.createDataFrame(list(FAILURES), "status int, error string").select("status", "error", net.retryable(F.col("status"), F.col("error")).alias("retryable"))


#: Reply, and what it must be taken for.
REPLIES = (
    ("1", 200, '{"cleaned": "QQ==", "kind": "pdf"}', None, True, 200, None, "pdf"), ("2", 200, '{"cleaned": "QQ=="}', None, True, 200, None, "unknown"), ("3", 200, "<html>", None, False, 200, "cleaner_bad_json status=200", None),
    ("4", 500, '{"error": "boom", "message": "m"}', None, False, 500, "boom", None), ("5", 422, '{"message": "m"}', None, False, 422, "m", None), ("6", 404, "{}", None, False, 404, "cleaner HTTP 404", None),
    ("7", 200, '{"ok": false, "error": "no"}', None, False, 200, "no", None), ("8", 200, '{"ok": true}', None, False, 502, "cleaner_missing_cleaned", None), ("9", 200, None, "timed out", False, 503, "cleaner_unreachable: timed out", None),
    ("10", 200, '{"cleaned": 5}', None, False, 502, "cleaner_missing_cleaned", None), ("11", 500, '{"error": 5}', None, False, 500, "cleaner HTTP 500", None), ("12", 200, "", None, False, 200, "cleaner_bad_json status=200", None),
)


@query(f"select case_id, ok, status, code, kind from {values('case_id, ok, status, code, kind', [(r[0], *r[4:]) for r in REPLIES])}")
def remote_classify(spark, sf_dir):
    rows = spark.createDataFrame([r[:4] for r in REPLIES], "case_id string, status int, body string, transport string")
    return rows.select("case_id", net.classify_reply(F.col("status"), F.col("body"), F.col("transport")).alias("r")).select("case_id", "r.*")


HEALTH = (("1", True, "production", None, 200), ("2", False, "production", "http://localhost:1", None), ("3", False, "production", "nope", None), ("4", False, "production", None, None), ("5", False, "development", "http://localhost:1", 204), ("6", False, "production", "https://c.example", 500), ("7", True, "production", "nope", None))


@query(
    f"""with u as {values('case_id, bound, environment, url, reply', HEALTH)}, {RESOLVE}, h as (select case_id, case when not bound and reason = 'loopback_unreachable_in_production' then 'invalid_loopback' when not bound and reason = 'invalid_cleaner_url' then 'down'
    when not bound and resolved is null then 'unconfigured' when reply between 200 and 299 then 'up' else 'down' end as status from x) select case_id, status, status <> 'unconfigured' as configured from h"""
)
def health_status(spark, sf_dir):
    rows = spark.createDataFrame(list(HEALTH), "case_id string, bound boolean, environment string, url string, reply int")
    return rows.select("case_id", net.health(F.col("bound"), F.col("environment"), F.col("url"), F.col("reply")).alias("h")).select("case_id", "h.*")


ERRORS = ("cleaner_unconfigured: no remote", "not_docx: x", "Cleaner_Unreachable: not_docx", "invalid_utf8: y", "something else", None)


@query(
    f"""select raw, case when regexp_matches(raw, '(?i)cleaner_unconfigured') then 'cleaner_unconfigured' when regexp_matches(raw, '(?i)not_docx') then 'not_docx' when regexp_matches(raw, '(?i)cleaner_unreachable') then 'cleaner_unreachable'
    when regexp_matches(raw, '(?i)invalid_utf8') then 'invalid_utf8' else coalesce(raw, 'error') end as category from {values('raw', [(e,) for e in ERRORS])}"""
)
def error_category(spark, sf_dir):
    return spark.createDataFrame([(e,) for e in ERRORS], "raw string").select("raw", net.error_category(F.col("raw")).alias("category"))


@query("select * from (values (1::bigint, 0::bigint, 0::bigint), (2, 250, 250), (3, 500, 750)) v(attempt, delay_ms, cumulative_ms)")
def retry_schedule(spark, sf_dir):
    return jb.retry_schedule(spark)
