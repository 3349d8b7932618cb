"""Bulletin pages: one HTML document per key, with a label and its section text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import classify, drop_prefix, html_section

# Labels in the order they are tested; phrases are accent-free and lower-case.
CLIMATE_RULES = (
    ("ENSO-Neutral", ("enso-neutral", "enso neutral")),
    ("La Niña", ("la nina",)),
    ("El Niño", ("el nino",)),
)


def read_page_files(spark: SparkSession, path: str, key_pattern: str = r"(\d{4})") -> DataFrame:
    """Whole HTML files as (key, html); the key is taken from the file name."""
    pages = spark.read.text(path, wholetext=True)
    key = F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1)
    return pages.select(key.alias("key"), F.col("value").alias("html"))


def label_pages(
    pages: DataFrame,
    keep: Sequence[str],
    html: str = "html",
    start: str = "Outlook:",
    stop: str = "Discussion:",
    rules: Sequence[tuple[str, Sequence[str]]] = CLIMATE_RULES,
    label: str = "enso_outlook",
    section: str = "outlook_text",
) -> DataFrame:
    """Extract the section of each page and classify it.

    A page without content gets the label ERROR and an empty section, so one
    bad page never stops the run.
    """
    text = drop_prefix(html_section(F.col(html), start, stop), start)
    cut = pages.select(*keep, F.col(html).isNull().alias("_missing"), F.trim(text).alias("_text"))
    named = classify(F.col("_text"), rules, "Unknown")
    return cut.select(
        *keep,
        F.when(F.col("_missing"), F.lit("ERROR")).otherwise(named).alias(label),
        F.coalesce(F.col("_text"), F.lit("")).alias(section),
    )
