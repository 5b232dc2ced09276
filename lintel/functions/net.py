"""Hosts, addresses, origins, routes and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Patterns of addresses and keys.
IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\z"
MAPPED_DOTTED = r"^(?:0:0:0:0:0:ffff:|::ffff:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})\z"
MAPPED_HEX = r"^(?:0:0:0:0:0:ffff:|::ffff:)([0-9a-f]{1,4}):([0-9a-f]{1,4})\z"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
BEARER = r"(?i)^Bearer\s+([^\n\r\x{2028}\x{2029}]+)\z"
#: A scheme, perhaps a user, and the host behind it.
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#@\[\]\s]+)(?::[0-9]*)?(?:[/?#]|\z)"
LOCAL_HOSTS = ("localhost", "localhost.", "::1", "0:0:0:0:0:0:0:1", "::", "0.0.0.0")


def ipv4_loopback(ip: Column) -> Column:
    part = lambda k: F.regexp_extract(ip, IPV4, k).try_cast("int")
    return F.coalesce((part(1) == 127) & (part(2) <= 255) & (part(3) <= 255) & (part(4) <= 255), F.lit(False))


def loopback_host(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"^\[|\]\z", "")
    word = lambda k: F.conv(F.regexp_extract(h, MAPPED_HEX, k), 16, 10).try_cast("int")
    first = F.shiftright(word(1), 8)
    return (
        F.when(host.isNull(), F.lit(False))
        .when(h.isin(*LOCAL_HOSTS), F.lit(True))
        .when(h.rlike(MAPPED_DOTTED), ipv4_loopback(F.regexp_extract(h, MAPPED_DOTTED, 1)))
        .when(h.rlike(MAPPED_HEX), first == 127)
        .otherwise(ipv4_loopback(h))
    )


def url_host(host: Column) -> Column:
    """A host as addresses name it: numbers in decimal, hexadecimal or octal, of one to four parts, are an IPv4 address, and zeros of IPv6 are left
    out. Null for a number that is no address.
    """
    h = F.lower(host)
    parts = F.split(F.regexp_replace(h, r"\.\z", ""), r"\.")
    last = F.element_at(parts, -1)

    def value(p):
        return (
            F.when(p.rlike(r"^0x[0-9a-f]{0,12}\z"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10).try_cast("long"))
            .when(p.rlike(r"^0[0-7]{1,12}\z"), F.conv(p, 8, 10).try_cast("long")).when(p.rlike(r"^(0|[1-9][0-9]{0,14})\z"), p.try_cast("long"))
        )

    n = F.transform(parts, value)
    count = F.size(parts)
    rest = F.element_at(n, -1)
    fits = (count <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, 1, count - 1), lambda x: x <= 255) & (rest < F.pow(F.lit(256), 5 - count))
    front = F.aggregate(F.transform(F.slice(n, 1, count - 1), lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    ip = front + rest
    dotted = F.concat_ws(".", *[(F.shiftright(ip, k).bitwiseAND(F.lit(255).cast("long"))).cast("string") for k in (24, 16, 8, 0)])
    six = F.regexp_replace(h, r"^\[|\]\z", "")
    short = F.when(six.rlike(r"^[0:]*:0{0,3}1\z"), "::1").when(six.rlike(r"^[0:]+\z"), "::").otherwise(F.regexp_replace(six, r"^[0:]*:ffff:", "::ffff:"))
    return F.when(h.contains(":"), short).when(~last.rlike(r"^([0-9]+|0x[0-9a-f]*)\z"), h).when(F.coalesce(fits, F.lit(False)), dotted)


def resolve_url(environment: Column, url: Column) -> Column:
    """struct(resolved, reason): where the remote service is, or why there is none."""
    raw = trimmed(url)
    host = url_host(F.nullif(F.regexp_extract(raw, HOST, 1), F.lit("")))
    reason = F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string")).when(host.isNull(), "invalid_cleaner_url").when(loopback_host(host) & (environment == "production"), "loopback_unreachable_in_production")
    resolved = F.when((F.coalesce(raw, F.lit("")) != "") & reason.isNull(), F.regexp_replace(raw, r"/\z", ""))
    return F.struct(resolved.alias("resolved"), reason.alias("reason"))


def remote_available(bound: Column, environment: Column, url: Column) -> Column:
    return bound | resolve_url(environment, url)["resolved"].isNotNull()


def origin_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, ORIGIN, 1)), F.lit(""))


def cors_origin(request_url: Column, origin: Column, allowed: Column) -> Column:
    """The origin to name in the reply: the request's own, or the one configured; null denies. Never a wildcard."""
    return F.when((origin == origin_of(request_url)) | ((allowed != "") & (origin == allowed)), origin)


def bearer_ok(header: Column, key: Column) -> Column:
    """Open without a key; else the token must equal it."""
    want = trimmed(F.coalesce(key, F.lit("")))
    return (want == "") | (F.regexp_extract(F.coalesce(header, F.lit("")), BEARER, 1) == want)


def route(method: Column, path: Column) -> Column:
    job = path.rlike(r"^/api/jobs/[^/]+\z")
    return (
        F.when((path == "/api/health") & (method == "GET"), "health")
        .when((path == "/api/upload") & (method == "POST"), "upload")
        .when(path.isin("/api/jobs", "/api/clean") & (method == "POST"), "start_job")
        .when(path.rlike(r"^/api/jobs/[^/]+/download\z") & (method == "GET"), "download")
        .when(path.rlike(r"^/api/jobs/[^/]+/report\z") & (method == "GET"), "job_report")
        .when((job | path.rlike(r"^/api/jobs/[^/]+/(download|report)\z")) & (method == "GET"), "job_status")
        .otherwise("not_found")
    )


def rate_limited_route(handler: Column) -> Column:
    return handler.isin("upload", "start_job")


def gate(method: Column, path: Column, header: Column, key: Column) -> Column:
    """The bearer test comes before routing; only health is exempt, whatever the method."""
    return F.when(~bearer_ok(header, key) & (path != "/api/health"), "unauthorized").otherwise(route(method, path))


def retryable(status: Column, error: Column) -> Column:
    return (status >= 500) | (status == 0) | F.coalesce(error.rlike("(?i)unreachable|timeout"), F.lit(False))


def classify_reply(status: Column, body: Column, transport_error: Column) -> Column:
    """struct(ok, status, code, kind) of a remote reply: a JSON body, or the error that kept it from coming."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    field = lambda k: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{k}", "string"))
    refused = ~status.between(200, 299) | F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.ok", "variant")) == "BOOLEAN", ~F.try_variant_get(parsed, "$.ok", "boolean")), F.lit(False))
    code = (
        F.when(transport_error.isNotNull(), F.concat(F.lit("cleaner_unreachable: "), transport_error))
        .when(~is_object, F.concat(F.lit("cleaner_bad_json status="), status.cast("string")))
        .when(refused, F.coalesce(field("error"), field("message"), F.concat(F.lit("cleaner HTTP "), status.cast("string"))))
        .when(field("cleaned").isNull(), F.lit("cleaner_missing_cleaned"))
    )
    out = F.when(transport_error.isNotNull(), 503).when(~is_object | refused, status).when(field("cleaned").isNull(), 502).otherwise(status)
    return F.struct(code.isNull().alias("ok"), out.alias("status"), code.alias("code"), F.when(code.isNull(), F.coalesce(field("kind"), F.lit("unknown"))).alias("kind"))


def health(bound: Column, environment: Column, url: Column, reply_status: Column) -> Column:
    """struct(status, configured): a bound service or a good address is up if its reply is; reply_status is null where none came."""
    at = resolve_url(environment, url)
    status = (
        F.when(~bound & (at["reason"] == "loopback_unreachable_in_production"), "invalid_loopback")
        .when(~bound & (at["reason"] == "invalid_cleaner_url"), "down")
        .when(~bound & at["resolved"].isNull(), "unconfigured")
        .when(reply_status.between(200, 299), "up")
        .otherwise("down")
    )
    return F.struct(status.alias("status"), (status != "unconfigured").alias("configured"))


def reply_headers(allowed: Column) -> Column:
    """The headers of a reply to a browser, as a map; empty where cors_origin named no origin."""
    fixed = {"access-control-allow-methods": "GET,POST,OPTIONS", "access-control-allow-headers": "authorization,content-type,idempotency-key", "vary": "Origin"}
    return F.when(allowed.isNotNull(), F.create_map(F.lit("access-control-allow-origin"), allowed, *[F.lit(x) for kv in fixed.items() for x in kv])).otherwise(F.create_map().cast("map<string,string>"))


def error_category(raw: Column) -> Column:
    """The first category that an error text names, else the text itself."""
    out = F.coalesce(raw, F.lit("error"))
    for word in ("invalid_utf8", "cleaner_unreachable", "not_docx", "cleaner_unconfigured"):
        out = F.when(raw.rlike(f"(?i){word}"), word).otherwise(out)
    return out
