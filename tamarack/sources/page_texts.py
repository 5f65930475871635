"""Texts of the pages of PDF files, as rows (url, page, text, bytes) of whatever extractor reads them.

A file over the size limit isn't taken. Pages without enough text aren't indexed, and a file with none that is gets its
transcriptions, where there are any. Null texts count as empty; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tidy
from ..functions.urls import document_id

#: The largest file and the shortest text.
MOST_BYTES, LEAST_CHARS = 25_000_000, 120


def skipped_files(pages: DataFrame) -> DataFrame:
    """url, reason of the files that are too large, or whose pages have next to no text."""
    files = pages.groupBy("url").agg(F.max("bytes").alias("bytes"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    reason = F.when(F.col("bytes") > MOST_BYTES, "too large").when(F.col("chars") < LEAST_CHARS, "scanned")
    return files.select("url", reason.alias("reason")).filter("reason IS NOT NULL")


def indexed_pages(pages: DataFrame, transcriptions: DataFrame | None = None) -> DataFrame:
    """id, url, page, text, transcribed: pages with enough text; transcriptions (url, page, text) of files that have none."""
    fits = pages.filter(F.col("bytes") <= MOST_BYTES)
    own = fits.select("url", "page", tidy(F.coalesce("text", F.lit(""))).alias("text")).filter(F.length("text") >= LEAST_CHARS).withColumn("transcribed", F.lit(False))
    if transcriptions is not None:
        bare = fits.select("url").distinct().join(own.select("url").distinct(), "url", "left_anti")
        other = transcriptions.select("url", "page", tidy(F.col("text")).alias("text")).filter(F.length("text") >= LEAST_CHARS)
        own = own.unionByName(other.join(bare, "url", "left_semi").withColumn("transcribed", F.lit(True)))
    return own.select(document_id(F.col("url"), F.col("page")).alias("id"), "url", "page", "text", "transcribed")
