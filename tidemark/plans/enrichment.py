"""Monthly panel plus event flags, annual label and economic covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import between_flag, month_start_from, since_flag, strict_date
from tidemark.functions.numbers import to_integer
from tidemark.operators.fill import fill_by_date
from tidemark.operators.joins import attach_dimension

# Fixed event dates, series catalogue and covariate names.
CLOSURE = ("2020-08-01", "2021-08-31")
CONTRACT_LOSS = "2023-08-01"
CATALOGUE = {
    "consumer_sentiment": "UMCSENT",
    "unemployment_rate": "UNRATE",
    "cpi": "CPIAUCSL",
    "gas_price": "GASREGW",
}
OBSERVED = ("2017-01-01", "2026-12-31")
ECONOMIC_COLUMNS = ("unemployment_rate", "cpi", "gas_price", "economic_pressure_index")


def with_date(panel: DataFrame, date: str = "date") -> DataFrame:
    """Month-start date from year and month unless the panel has one."""
    if date in panel.columns:
        return panel.withColumn(date, strict_date(F.col(date)))
    if {"year", "month"} <= set(panel.columns):
        return panel.withColumn(date, month_start_from(F.col("year"), F.col("month")))
    raise ValueError("the panel needs a date column or both year and month")


def with_event_flags(
    panel: DataFrame, date: str = "date", closure: tuple[str, str] = CLOSURE, loss: str = CONTRACT_LOSS
) -> DataFrame:
    """Flags for the closed closure interval and for every date from the loss on."""
    return panel.withColumns(
        {
            "covid_flag": between_flag(F.col(date), *closure),
            "cms_loss_flag": since_flag(F.col(date), loss),
        }
    )


def enrich_panel(
    panel: DataFrame,
    labels: DataFrame,
    economics: DataFrame,
    label: str = "enso_outlook",
    economic_columns: Sequence[str] = ECONOMIC_COLUMNS,
    date: str = "date",
    closure: tuple[str, str] = CLOSURE,
    loss: str = CONTRACT_LOSS,
) -> DataFrame:
    """Add flags, the year's label (filled over gaps) and monthly covariates."""
    flagged = with_event_flags(with_date(panel, date), date, closure, loss).withColumn("year", F.year(date))
    annual = labels.select(to_integer(F.col("year")).alias("year"), label)
    labelled = fill_by_date(attach_dimension(flagged, annual, ["year"], [label]), [label], date)
    full = attach_dimension(labelled, economics, ["year", "month"], economic_columns)
    first = list(panel.columns)
    return full.select(*first, *[c for c in full.columns if c not in first])
