"""Formats of documents, and migration of an older layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parser_of(name: Column) -> Column:
    """Which parser the last part of a file name asks for."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when(ext.isin("pdf", "docx", "pptx"), ext).otherwise("unsupported")


def slide_text(xml: Column) -> Column:
    """The texts of a slide's XML, joined by spaces."""
    return F.array_join(F.regexp_extract_all(xml, F.lit(r"<a:t[^>]*>([^<]*)</a:t>"), F.lit(1)), " ")


#: What an older status became; all others are drafts.
STATUS = {"posted": "published", "ready": "ready"}


def migrated(old: DataFrame) -> DataFrame:
    """id, status, platform, text to id, status, platforms (an array), content (a map by platform)."""
    renamed = F.lit("draft")
    for a, b in STATUS.items():
        renamed = F.when(F.col("status") == a, b).otherwise(renamed)
    return old.select("id", renamed.alias("status"), F.array("platform").alias("platforms"), F.create_map("platform", "text").alias("content"))
