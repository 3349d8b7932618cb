"""Consecutive numbers for the rows of a distributed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep_sized
from tidemark.session import keep_table

#: ``monotonically_increasing_id`` holds a partition's number above this many bits of row place.
PLACE_BITS = 33


def number_rows(rows: DataFrame, order: Sequence[str], group: str | None = None) -> DataFrame:
    """``rows`` with ``index``, from 0 in the order of ``order``, within each ``group`` if one is named.

    Rows are cut into key ranges and sorted there; a range counts its rows of each
    group, and only those counts are summed in order. Rows that agree in all keys are
    told apart by their place in the scan, so neither a frequent key, nor a group
    with most of the rows, nor a row that repeats stays in one task. Rows that agree
    in all columns are interchangeable; let ``order`` hold a digest of whatever else
    must come out alike in every run. Nulls come first; ``group`` holds no null.
    ``rows`` has no columns ``index``, ``salt``, ``place``, ``part``, ``of_part`` or
    ``of_group``.
    """
    keys = [*([group] if group else []), *order]
    by = [F.col(k).asc_nulls_first() for k in [*keys, "salt"]]
    placed = keep_table(
        rows.withColumn("salt", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("salt")
        .withColumn("part", F.shiftright("place", PLACE_BITS))
    )
    within = [group] if group else []
    # One row for each range and group in it.
    counts = placed.groupBy(*within, "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("part").alias("of_part"),
        *[F.col(g).alias("of_group") for g in within],
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    match = F.col("part") == F.col("of_part")
    if group:
        match &= F.col(group) == F.col("of_group")
    return placed.join(keep_sized(starts), match).select(
        *[c for c in rows.columns], (F.col("place") + F.col("shift")).alias("index")
    )
