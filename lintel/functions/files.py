"""Names, types and sizes of files: admission, routing, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TEXT_EXTENSIONS, trimmed

#: Extensions that are let in, those that are refused by name, and refused content types.
ALLOWED = (
    "txt", "md", "markdown", "html", "htm", "svg", "png", "jpg", "jpeg", "webp", "avif", "heic", "heif", "bmp", "gif", "tif", "tiff",
    "pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "mp4", "mov", "m4a", "m4v", "wav", "mp3", "flac",
)
BLOCKED = ("exe", "dll", "bat", "cmd", "com", "scr", "js", "mjs", "cjs", "sh", "ps1", "php", "wasm")
BLOCKED_TYPES = ("application/x-msdownload", "application/x-executable")
PACKAGE_EXTENSIONS = ("docx",)
PACKAGE_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

#: Limits in bytes and milliseconds.
MAX_BYTES = 33_554_432
HEADER_SLACK = 1_048_576
TIMEOUT_MS = 20_000
MAX_ATTEMPTS = 3
STALE_MS = 45_000
BACKOFF_MS = 250

#: Patterns, the same in Java and RE2. \z is the end itself: $ would let a line break stand behind it.
EXTENSION = r"[^/\\]\.([^./\\]+)\z"
LAST_SEGMENT = r"([^/\\]*)\z"
NAME_RUNS = r"[^\w.\- ()\[\]]+"
JOB_ID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def extension_of(name: Column) -> Column:
    """Lower-case text behind the last dot of the last path segment; empty for none, or a dot only in front or at the end."""
    return F.lower(F.regexp_extract(name, EXTENSION, 1))


def content_type_of(raw: Column) -> Column:
    return trimmed(F.split(F.lower(raw), ";")[0])


def admission(name: Column, content_type: Column, size: Column, cap: Column | int = MAX_BYTES) -> Column:
    """The first rule that refuses a file, or `ok`."""
    ext = extension_of(name)
    return (
        F.when(size <= 0, "empty_file")
        .when(size > (F.lit(cap) if isinstance(cap, int) else cap), "file_too_large")
        .when(ext == "", "missing_extension")
        .when(ext.isin(*BLOCKED), "extension_blocked")
        .when(~ext.isin(*ALLOWED), "extension_not_allowed")
        .when(content_type_of(content_type).isin(*BLOCKED_TYPES), "content_type_blocked")
        .otherwise("ok")
    )


def admission_status(code: Column) -> Column:
    return F.when(code == "ok", 200).when(code == "file_too_large", 413).otherwise(400)


def header_too_large(length: Column, cap: int = MAX_BYTES) -> Column:
    """The early test of a declared length, before the body is there."""
    return length > cap + HEADER_SLACK


def is_text(ext: Column) -> Column:
    return F.lower(ext).isin(*TEXT_EXTENSIONS)


def is_package(ext: Column) -> Column:
    return F.lower(ext).isin(*PACKAGE_EXTENSIONS)


def backend(ext: Column, remote: bool = True) -> Column:
    """Who cleans a file of this extension."""
    return F.when(is_text(ext), "worker-layer-a").when(is_package(ext), "worker-ooxml").otherwise("remote-cleaner" if remote else "cleaner_unconfigured")


def job_id_valid(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(JOB_ID), F.lit(False))


def object_key(job_id: Column, kind: str) -> Column:
    """kind: original, cleaned, report.json or meta.json. The file's own name is never part of a key."""
    return F.concat(F.lit("uploads/"), job_id, F.lit(f"/{kind}"))


def parse_positive(raw: Column, default: float) -> Column:
    """A positive finite number, else the default; only decimal text is read as a number."""
    text = trimmed(raw)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value).otherwise(F.lit(float(default)))


def download_name(name: Column) -> Column:
    """A safe name of at most 180 characters with `.cleaned` before its extension. The cut may take the extension away."""
    base = F.substring(F.regexp_replace(F.regexp_extract(name, LAST_SEGMENT, 1), NAME_RUNS, "_"), 1, 180)
    own = extension_of(name)
    fallback = F.when(own == "", "bin").otherwise(own)
    ext = extension_of(base)
    return (
        F.when((base == "") | F.startswith(base, F.lit(".")), F.concat(F.lit("cleaned."), fallback))
        .when(ext == "", F.concat(base, F.lit(".cleaned."), fallback))
        .otherwise(F.concat(F.regexp_replace(base, r"\.[^.]*\z", ""), F.lit(".cleaned."), ext))
    )


def format_size(n: Column) -> Column:
    """B, KiB or MiB with one decimal, halves up, in whole numbers."""

    def scaled(unit: int, label: str) -> Column:
        tenths = F.floor((n * 20 + unit) / (2 * unit))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {label}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KiB")).otherwise(scaled(1 << 20, "MiB"))
