"""Text scrub over tables of documents: one narrow stage, no shuffle until something is rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: The error of bytes that aren't text, and the type of cleaned text.
NOT_UTF8, TEXT_TYPE = "invalid_utf8: Layer A expects UTF-8 text", "text/plain; charset=utf-8"


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with cleaned, removed_count and residual, the latter counted again on what is left.

    A text without marks, as most are, is scanned once; only the others are rewritten and scanned again.
    """
    dirty = df.withColumn("__dirty", F.col(text).rlike(tx.STRIP_CLASS))
    cleaned = dirty.withColumn("cleaned", F.when(F.col("__dirty"), tx.strip_marks(F.col(text))).otherwise(F.col(text)))
    removed = F.length(F.col(text)) - F.length("cleaned")
    return cleaned.withColumns({"removed_count": removed, "residual": F.when(F.col("__dirty"), tx.count_marks(F.col("cleaned"))).otherwise(removed * 0)}).drop("__dirty")


def inspect_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with removed_count and suspicious; nothing is rewritten."""
    out = df.withColumn("removed_count", tx.count_marks(F.col(text)))
    return out.withColumn("suspicious", F.col("removed_count") > 0)


def mark_histogram(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Counts of each code point by group. Only marks are exploded, and they are summed before they are dealt out."""
    return df.select(*by, F.explode(tx.mark_codes(F.col(text))).alias("code_point")).groupBy(*by, "code_point").agg(F.count("*").alias("n"))


def text_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the report columns of a cleaned text. Only texts with marks are gone through for their histogram."""
    out = clean_text(df, text)
    codes = F.when(F.col("removed_count") > 0, tx.mark_codes(F.col(text))).when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    return out.withColumns({"kind": F.lit("text"), "layer": F.lit("A"), "backend": F.lit("worker-layer-a"), "removed": tx.histogram(codes), "note": F.lit(tx.NOTE)})


def clean_bytes(df: DataFrame, data: str = "content") -> DataFrame:
    """The text job on bytes: error where they aren't UTF-8, else cleaned bytes and counts. A leading byte order mark goes uncounted.

    A text without marks is scanned once, as in clean_text.
    """
    decoded = df.withColumn("__text", tx.decode_utf8(F.col(data))).withColumn("__dirty", F.col("__text").rlike(tx.STRIP_CLASS))
    error = F.when(F.col("__text").isNull(), F.lit(NOT_UTF8))
    rest = F.when(F.col("__dirty"), tx.strip_marks(F.col("__text"))).otherwise(F.col("__text"))
    out = decoded.withColumn("__rest", rest)
    out = out.withColumns({"cleaned": F.col("__rest").cast("binary"), "removed_count": F.length("__text") - F.length("__rest"), "error": error, "content_type": F.lit(TEXT_TYPE)})
    return out.drop("__text", "__dirty", "__rest")


def merge_histograms(df: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """Code points and counts of each row over several columns of codes, without a shuffle."""
    together = F.concat(*[F.col(c) for c in codes])
    per = df.select(key, together.alias("codes")).select(key, "codes", F.explode(F.array_distinct("codes")).alias("code_point"))
    return per.select(key, "code_point", F.expr("cast(size(filter(codes, c -> c = code_point)) as bigint)").alias("n"))
