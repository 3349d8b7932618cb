"""Month and year rollups, group statistics and table profiles.

All of these are partial aggregations: map tasks combine before the shuffle,
so a key that holds a third of the rows sends one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start, month_start_from


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with a null key are left out of every rollup."""
    return reduce(lambda rows, key: rows.filter(F.col(key).isNotNull()), keys, df)


def with_month_parts(df: DataFrame, date: str, year: str = "year", month: str = "month") -> DataFrame:
    """Integer year and month columns of a date or timestamp."""
    return df.withColumn(year, F.year(date)).withColumn(month, F.month(date))


def sum_or_zero(value: Column) -> Column:
    """Sum in which an all-null group is 0, not null."""
    return F.coalesce(F.sum(value), F.lit(0))


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, str] | None = None,
    means: Mapping[str, str] | None = None,
    counts: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    first_order: str | None = None,
    present: Sequence[str] | None = None,
) -> DataFrame:
    """Group by keys; each mapping is output name -> input column.

    Rows with a null key are dropped; ``present`` limits the check to the keys
    that can be null, for keys costly to work out. ``firsts`` takes the first non-null value by a numeric ``first_order``
    column, or the smallest value when there is none, so reruns agree.
    """
    sums, means, counts, firsts = sums or {}, means or {}, counts or {}, firsts or {}
    rows = drop_null_keys(df, keys if present is None else present)
    if not firsts:
        return rows.groupBy(*keys).agg(
            *[sum_or_zero(F.col(c)).alias(n) for n, c in sums.items()],
            *[F.avg(c).alias(n) for n, c in means.items()],
            *[F.count(c).alias(n) for n, c in counts.items()],
        )
    # Text cannot live in a hash aggregation's buffer: it would sort all rows. As
    # a grouping key it can, and the few distinct values are settled afterwards.
    place = F.min(first_order) if first_order else F.lit(0)
    fine = rows.select("*", *[F.col(c).alias(f"_f_{n}") for n, c in firsts.items()])
    fine = fine.groupBy(*keys, *[f"_f_{n}" for n in firsts]).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.sum(F.col(c).cast("double")).alias(f"_t_{n}") for n, c in means.items()],
        *[F.count(c).alias(f"_c_{n}") for n, c in {**means, **counts}.items()],
        place.alias("_place"),
    )

    def first(name: str) -> Column:
        value = F.col(f"_f_{name}")
        return F.min_by(value, F.when(value.isNotNull(), F.struct("_place", value)))

    return fine.groupBy(*keys).agg(
        *[sum_or_zero(F.col(f"_s_{n}")).alias(n) for n in sums],
        *[F.try_divide(F.sum(f"_t_{n}"), F.sum(f"_c_{n}")).alias(n) for n in means],
        *[F.sum(f"_c_{n}").alias(n) for n in counts],
        *[first(n).alias(n) for n in firsts],
    )


def monthly_rollup(df: DataFrame, date: str, series: Sequence[str], **aggregates) -> DataFrame:
    """Rollup by (series, year, month) with the month start as ``year_month``."""
    months = with_month_parts(df.filter(F.col(date).isNotNull()), date)
    out = rollup(months, [*series, "year", "month"], present=series, **aggregates)
    return out.withColumn("year_month", month_start_from(F.col("year"), F.col("month")))


def aggregate_to_month(
    df: DataFrame, value: str, agg: str = "mean", date: str = "date", keys: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """One value per month: ``mean``, ``sum`` (0 for no values) or ``last``.

    ``last`` is the latest non-null value; ``tie`` orders equal dates.
    """
    column = F.col(value)
    if agg == "mean":
        result = F.avg(column)
    elif agg == "sum":
        result = sum_or_zero(column)
    elif agg == "last":
        result = F.max_by(column, F.when(column.isNotNull(), F.struct(date, *tie)))
    else:
        raise ValueError(f"unsupported agg: {agg}")
    months = with_month_parts(df.filter(F.col(date).isNotNull()), date)
    out = drop_null_keys(months, keys).groupBy(*keys, "year", "month").agg(result.alias(value))
    return out.withColumn("year_month", month_start_from(F.col("year"), F.col("month")))


def group_stats(df: DataFrame, key: str, value: str, top: int | None = 20) -> DataFrame:
    """Mean, sample standard deviation and count per group, widest spread first."""
    stats = (
        drop_null_keys(df, [key])
        .groupBy(key)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    )
    if top is None:
        return stats
    return stats.orderBy(F.col("std").desc_nulls_last(), key).limit(top)


def price_points(df: DataFrame, value: str, key: str, top: int = 50) -> DataFrame:
    """How often each (value, key) pair occurs, lowest values first."""
    counted = drop_null_keys(df, [value, key]).groupBy(value, key).agg(F.count(value).alias("count"))
    return counted.orderBy(value, key).limit(top)


def profile(df: DataFrame, date: str, key: str) -> DataFrame:
    """Date range, row count and number of distinct keys of a table."""
    return df.agg(
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(key).alias("key_count"),
    )


def profile_by(df: DataFrame, date: str, key: str) -> DataFrame:
    """Date range and row count of every key."""
    return (
        drop_null_keys(df, [key])
        .groupBy(key)
        .agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"), F.count(F.lit(1)).alias("row_count"))
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return drop_null_keys(df.select(*columns), columns).distinct().orderBy(*columns)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value.

    Counts come first, so no task ever holds the value table of a whole group.
    """
    rows = drop_null_keys(df, keys).filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias(name or value))


def to_month_start(df: DataFrame, date: str, name: str = "year_month") -> DataFrame:
    return df.withColumn(name, month_start(F.col(date)))
