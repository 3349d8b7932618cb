"""Monthly covariates: pivot, percent change, z-scores and the composite index.

These tables have one row per month, so their ordered windows span the
calendar, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start_from
from tidemark.functions.numbers import safe_zscore
from tidemark.operators.rollup import with_month_parts

# Sign of each z-score in the pressure index.
PRESSURE_SIGNS = {
    "gas_price_z": 1,
    "cpi_yoy_pct_z": 1,
    "unemployment_rate_z": 1,
    "consumer_sentiment_z": -1,
}
Z_COLUMNS = ("gas_price", "cpi_yoy_pct", "unemployment_rate", "consumer_sentiment")


def pivot_series(
    observations: DataFrame, names: Sequence[str], series: str = "series", date: str = "date", value: str = "value"
) -> DataFrame:
    """Long observations to one row per month with a mean column per series.

    Same rows as joining one monthly table per series with outer joins, in one
    shuffle of partial aggregates.
    """
    months = with_month_parts(observations.filter(F.col(date).isNotNull()), date)
    wide = months.groupBy("year", "month").agg(
        *[F.avg(F.when(F.col(series) == n, F.col(value))).alias(n) for n in names],
        F.max(F.col(series).isin(*names)).alias("_any"),
    )
    kept = wide.filter("_any").drop("_any")
    return kept.withColumn("year_month", month_start_from(F.col("year"), F.col("month")))


def pct_change(
    df: DataFrame, value: str, order: Sequence[str], periods: int = 12, keys: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Percent change against the row ``periods`` back; nulls are not padded."""
    window = Window.partitionBy(*keys).orderBy(*order)
    earlier = F.lag(value, periods).over(window)
    change = (F.try_divide(F.col(value), earlier) - 1) * 100
    return df.withColumn(name or f"{value}_yoy_pct", change)


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_z`` from the whole-column mean and sample deviation.

    All statistics are one aggregation to one row, which is joined to every row:
    the table is read twice, whatever the number of columns.
    """
    if not columns:
        return df
    statistics = df.agg(
        *[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"_std_{i}") for i, c in enumerate(columns)],
    )
    joined = df.crossJoin(F.broadcast(statistics))  # a global aggregate: exactly one row
    scored = [
        safe_zscore(F.col(c), F.col(f"_mean_{i}"), F.col(f"_std_{i}")).alias(f"{c}_z") for i, c in enumerate(columns)
    ]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *scored)


def signed_sum(df: DataFrame, signs: Mapping[str, int] = PRESSURE_SIGNS, name: str = "economic_pressure_index") -> DataFrame:
    """Sum of signed columns, null if any is null; skipped when one is absent."""
    if not set(signs) <= set(df.columns):
        return df
    total = None
    for column, sign in signs.items():
        term = F.col(column) if sign > 0 else -F.col(column)
        total = term if total is None else total + term
    return df.withColumn(name, total)


def economic_features(observations: DataFrame, names: Sequence[str], price_index: str = "cpi") -> DataFrame:
    """Pivot, year-over-year change, z-scores and index of named series."""
    wide = pivot_series(observations, names)
    changed = pct_change(wide, price_index, ["year", "month"])
    return signed_sum(zscores(changed, [c for c in Z_COLUMNS if c in changed.columns]))
