"""Invisible code points: find, count and remove them, as expressions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 60 code points that are removed, as a character class that Java and RE2 read alike.
STRIP_CLASS = (
    r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{AD}\x{34F}\x{180E}\x{200B}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0001}]"
)

#: What every report says.
NOTE = (
    "Layer A and metadata stripping are verifiable. Statistical text watermarks are not certified removed. "
    "Never: Anthropic watermark guaranteed removed."
)

#: Extensions of text that is cleaned here.
TEXT_EXTENSIONS = ("txt", "md", "markdown", "html", "htm", "svg")

BOM = "﻿"

#: Fixed values of the optional wider pass: spaces of fixed widths that become a plain space.
SPACES = "              　"


def strip_marks(text: Column) -> Column:
    """The text without the listed code points; the rest keeps its order."""
    return F.regexp_replace(text, STRIP_CLASS, "")


def count_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STRIP_CLASS))


def mark_codes(text: Column) -> Column:
    """The listed code points of a text in order, as U+XXXX of at least four digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(STRIP_CLASS), F.lit(0)), lambda c: F.format_string("U+%04X", F.ascii(c)))


def histogram(codes: Column) -> Column:
    """A map of code point to count, from an array of codes."""
    keys = F.array_sort(F.array_distinct(codes))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(codes, lambda c: c == k))))


def histogram_text(codes: Column) -> Column:
    """The same as text: code=count, in order of code, parted by semicolons."""
    keys = F.array_sort(F.array_distinct(codes))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.size(F.filter(codes, lambda c: c == k)).cast("string"))), ";")


#: Fixed value: what counts as white space around a header, a key or an address.
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(text: Column) -> Column:
    """Without white space at both ends; F.trim takes spaces alone."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def drop_leading_bom(text: Column) -> Column:
    """Decoding takes one byte order mark at the start away, without counting it."""
    return F.when(F.startswith(text, F.lit(BOM)), F.substr(text, F.lit(2))).otherwise(text)


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def decode_utf8(data: Column) -> Column:
    """Text of valid UTF-8 without a leading byte order mark; null if the bytes aren't valid."""
    return F.when(valid_utf8(data), drop_leading_bom(data.cast("string")))


def normalize_spaces(text: Column) -> Column:
    """Optional, apart from the listed code points: spaces of other widths become plain ones."""
    return F.translate(text, SPACES, " " * len(SPACES))


def clean_struct(text: Column) -> Column:
    """cleaned, removed_count and removed (map) of a text."""
    codes = mark_codes(text)
    return F.struct(strip_marks(text).alias("cleaned"), F.size(codes).alias("removed_count"), histogram(codes).alias("removed"))


def sanitize_error(text: Column) -> Column:
    """One line of at most 500 characters."""
    return F.substring(F.regexp_replace(text, r"[\x{00}-\x{1F}]", " "), 1, 500)
