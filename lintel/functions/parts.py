"""Parts of word-processor packages: which go, and what goes from their XML."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go from the core and application properties.
CORE_DROP = ("dc:creator", "cp:lastModifiedBy", "cp:revision", "cp:lastPrinted", "dcterms:created", "dcterms:modified", "cp:keywords", "dc:description", "dc:subject", "cp:category", "cp:contentStatus")
APP_DROP = ("Application", "AppVersion", "Company", "Manager", "Template", "TotalTime")

#: Words that mark a custom property, by itself or as two neighbours put together.
PROPERTY_WORDS = ("ai", "llm", "gpt", "chatgpt", "openai", "claude", "anthropic", "gemini", "bard", "copilot", "synthid", "c2pa", "contentcredential", "contentcredentials", "provenance", "watermark", "generator", "generated")

#: Names of provenance parts; property blocks; the name in a block.
PROVENANCE = r"(?i)(^|/)(c2pa|contentcredentials)[^/]*(/|$)|\.c2pa$"
BLOCK = r"<property\b[\s\S]*?</property>"
BLOCK_NAME = r'\bname="([^"]*)"'
SPLITS = ((r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"([a-z0-9])([A-Z])", r"\1 \2"))

BODY_PART = "word/document.xml"

#: How a package's report words what it took away, and the prefix of what stops it.
DROPPED_PARTS, DROPPED_PROPERTIES = "removed provenance parts: {}", "stripped from {}: {}"
REFUSED = "not_docx"

#: An element that refers to a part, for the parts that hold such elements; {} is the address.
REFERENCES = {"[content_types].xml": r'(?i)<Override\b[^>]*PartName="(?:{})"[^>]*/>', ".rels": r'(?i)<Relationship\b[^>]*Target="[^"]*(?:{})"[^>]*/>'}
#: The parts that hold properties, and the elements that go from each; of custom ones, whole blocks by their names.
PROPERTY_PARTS = {"docProps/core.xml": CORE_DROP, "docProps/app.xml": APP_DROP, "docProps/custom.xml": None}


def is_xml_part(name: Column) -> Column:
    return F.lower(name).endswith(".xml") | F.lower(name).endswith(".rels")


def is_provenance(name: Column) -> Column:
    return name.rlike(PROVENANCE)


def zip_magic(data: Column) -> Column:
    return (F.length(data) >= 4) & F.hex(F.substring(data, 1, 3)).isin("504B03", "504B05", "504B07")


def element(tag: str) -> str:
    """Fixed pattern: an element of this name, empty or with its end tag. An empty one with attributes reaches to a later end tag, where there is one."""
    t = re.escape(tag).replace(r"\:", ":")
    return rf"<{t}(?:\s[^>]*)?(?:/>|>[\s\S]*?</{t}>)"


def name_words(name: Column) -> Column:
    x = name
    for pattern, to in SPLITS:
        x = F.regexp_replace(x, pattern, to.replace("\\", "$"))
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def property_flagged(name: Column) -> Column:
    words = name_words(name)
    known = F.array(*[F.lit(w) for w in PROPERTY_WORDS])
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, b))
    return F.arrays_overlap(words, known) | F.arrays_overlap(pairs, known)


def drop_custom(xml: Column) -> Column:
    """The XML without blocks of flagged custom properties."""
    blocks = F.regexp_extract_all(xml, F.lit(BLOCK), F.lit(0))
    kept = F.transform(blocks, lambda b: F.when(property_flagged(F.regexp_extract(b, BLOCK_NAME, 1)), "").otherwise(b))
    between = F.split(xml, BLOCK, -1)
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
