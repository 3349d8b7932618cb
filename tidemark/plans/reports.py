"""Data behind the report figures; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start_from
from tidemark.operators.distributions import density, histogram
from tidemark.operators.joins import keep_top_groups, stack_frames
from tidemark.operators.rollup import price_points, rollup
from tidemark.plans.panel import HOME_COUNTRY, with_country


def yearly_trends(
    panel: DataFrame, series: str, sums: Sequence[str], means: Sequence[str], year: str = "year"
) -> DataFrame:
    """Yearly totals and means per series."""
    return rollup(panel, [year, series], sums={c: c for c in sums}, means={c: c for c in means})


def price_range(rows: DataFrame, value: str, low: float = 100, high: float = 2000) -> DataFrame:
    """Rows strictly inside the open price range."""
    return rows.filter((F.col(value) > low) & (F.col(value) < high))


def price_histogram(rows: DataFrame, group: str, value: str, k: int = 12, bins: int = 30) -> DataFrame:
    """Histogram of each of the k most frequent groups."""
    return histogram(keep_top_groups(rows, group, value, k), group, value, bins)


def price_density(rows: DataFrame, group: str, value: str, k: int = 12, points: int = 200) -> DataFrame:
    return density(keep_top_groups(rows, group, value, k), group, value, points)


def monthly_prices(panel: DataFrame, series: str, value: str, k: int = 10) -> DataFrame:
    """Monthly values of the k series with most known values."""
    known = panel.na.drop(subset=[value, "month", "year", series])
    top = keep_top_groups(known, series, value, k)
    return top.withColumn("year_month", month_start_from(F.col("year"), F.col("month")))


def home_price_points(
    rows: DataFrame, value: str, group: str, country: str = HOME_COUNTRY, top: int = 50
) -> DataFrame:
    """Most basic price points of one country."""
    return price_points(with_country(rows).filter(F.col("country") == country), value, group, top)


def actual_and_forecast(
    actual: DataFrame, forecast: DataFrame, series: str, date: str, target: str
) -> DataFrame:
    """Actual targets and each model's forecast as one long table."""
    known = actual.select(series, F.col(date).alias("date"), F.lit("actual").alias("line"), F.col(target).alias("value"))
    ahead = forecast.select(series, "date", F.col("model_name").alias("line"), F.col("prediction").alias("value"))
    lines = ahead.select(series).distinct()
    return stack_frames([known.join(lines, series, "left_semi"), ahead])
