"""Calendar, lag and rolling features of a monthly panel.

A panel has one row per (series, month): a rollup makes it. However many raw
rows a series has, its panel is no longer than the calendar, so windows over a
series are short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidemark.functions.dates import SEASONS, cyclic, member_flag

LAGS = (1, 2, 3, 12)
ROLL_WINDOWS = (3, 12)
SEASON_LAG = 12

CALENDAR_FEATURES = (
    "year_num",
    "month_num",
    "quarter",
    "month_sin",
    "month_cos",
    "quarter_sin",
    "quarter_cos",
    *SEASONS,
)


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Year, month, quarter, their cyclic encodings and season flags."""
    month, quarter = F.month(date), F.quarter(date)
    month_sin, month_cos = cyclic(month, 12)
    quarter_sin, quarter_cos = cyclic(quarter, 4)
    return df.withColumns(
        {
            "year_num": F.year(date),
            "month_num": month,
            "quarter": quarter,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "quarter_sin": quarter_sin,
            "quarter_cos": quarter_cos,
            **{name: member_flag(month, months) for name, months in SEASONS.items()},
        }
    )


def full_window_mean(value: Column, window: WindowSpec, size: int) -> Column:
    """Mean of the ``size`` rows before this one, null unless all have a value."""
    frame = window.rowsBetween(-size, -1)
    return F.when(F.count(value).over(frame) == size, F.avg(value).over(frame))


def lag_features(
    df: DataFrame,
    series: str,
    date: str,
    target: str,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = ROLL_WINDOWS,
    calendar: bool = False,
) -> DataFrame:
    """Lags, full-window rolling means of earlier rows and a seasonal difference.

    Lags count rows, not calendar months: a series that skips months reaches
    further back. With ``calendar`` they count months, see ``calendar_lag_features``.
    All columns share one exchange and one sort.
    """
    if calendar:
        return calendar_lag_features(df, series, date, target, lags, windows)
    window = Window.partitionBy(series).orderBy(date)
    value = F.col(target)
    added = {f"{target}_lag_{k}": F.lag(value, k).over(window) for k in lags}
    added |= {f"{target}_roll_mean_{w}": full_window_mean(value, window, w) for w in windows}
    added[f"{target}_seasonal_diff"] = value - F.lag(value, SEASON_LAG).over(window)
    return df.withColumns(added)


def calendar_lag_features(
    df: DataFrame,
    series: str,
    date: str,
    target: str,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = ROLL_WINDOWS,
) -> DataFrame:
    """The columns of ``lag_features`` by calendar month.

    A lag is the value of the month so many months back, null where the series skips
    it, and a rolling mean needs a value in every month of its window. Of several rows
    in a month the mean counts, once. Rows without a date have no lags. Range frames on
    the month's number share one exchange and one sort.
    """
    number, own, share = "_month_number", "_month_value", "_month_share"
    month = Window.partitionBy(series, number)
    placed = df.withColumn(number, F.year(date) * 12 + F.month(date))
    placed = placed.withColumn(own, F.avg(target).over(month))
    # A month's rows share its weight of one, so that it counts once in a window's sum.
    placed = placed.withColumn(share, F.when(F.col(own).isNotNull(), 1 / F.count(F.lit(1)).over(month)))
    window = Window.partitionBy(series).orderBy(number)
    dated = F.col(number).isNotNull()

    def back(k: int) -> Column:
        return F.when(dated, F.avg(own).over(window.rangeBetween(-k, -k)))

    def mean(w: int) -> Column:
        frame = window.rangeBetween(-w, -1)
        whole = F.round(F.sum(share).over(frame)) == w
        return F.when(dated & whole, F.sum(F.col(own) * F.col(share)).over(frame) / w)

    added = {f"{target}_lag_{k}": back(k) for k in lags}
    added |= {f"{target}_roll_mean_{w}": mean(w) for w in windows}
    added[f"{target}_seasonal_diff"] = F.col(target) - back(SEASON_LAG)
    return placed.withColumns(added).drop(number, own, share)


def panel_features(df: DataFrame, series: str, date: str, target: str, calendar: bool = False) -> DataFrame:
    return lag_features(calendar_features(df, date), series, date, target, calendar=calendar)


def lag_columns(columns: Sequence[str]) -> list[str]:
    """Columns that must be known for a row to be usable in training."""
    return [c for c in columns if "_lag_" in c or "_roll_" in c]


def feature_columns(
    df: DataFrame, exclude: Sequence[str], target: str, exclude_leaky: Sequence[str] = ()
) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names.

    ``exclude_leaky`` names columns known only together with the target (the
    seasonal difference contains it); the default keeps them.
    """
    skipped = {target, "year", "month", *exclude, *exclude_leaky}
    fields = [f for f in df.schema.fields if f.name not in skipped]
    # A flag is a number, 0 or 1.
    plain = (T.NumericType, T.BooleanType)
    numeric = [f.name for f in fields if isinstance(f.dataType, plain)]
    categorical = [f.name for f in fields if not isinstance(f.dataType, plain)]
    return numeric, categorical


def usable_rows(features: DataFrame, target: str) -> DataFrame:
    """Rows with a target and every lag and rolling column."""
    return features.na.drop(how="any", subset=[target, *lag_columns(features.columns)])
