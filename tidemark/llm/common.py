"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import keep_table

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes, as JSON text, of a table that is sent to every executor.
BROADCAST_BYTES = 8_000_000


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def keep_sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write a table to the shared folder and mark it for broadcast if it is small.

    The size is measured on the written rows, as the length of their JSON text,
    which is more than Spark needs for them. A larger table stays unmarked: joins
    then shuffle it, and adaptive execution splits skewed keys.
    """
    held = keep_table(df)
    size = held.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(held) if size <= limit else held


def hex_digest(text: Column) -> Column:
    return F.sha2(text, 256)
