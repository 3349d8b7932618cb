"""Economic series: landed JSON payloads to one long (series, date, value) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import strict_date
from tidemark.functions.numbers import to_number

PAYLOAD_SCHEMA = "observations array<struct<date: string, value: string>>"


def observations_from_json(
    payloads: DataFrame, payload: str, keep: tuple[str, ...] = (), first: str | None = None, last: str | None = None
) -> DataFrame:
    """Explode a JSON text column into typed (date, value) rows.

    A payload without observations adds no rows; with none at all the result
    is empty but typed. A value that is not a number becomes null.
    """
    parsed = payloads.select(*keep, F.from_json(F.col(payload), PAYLOAD_SCHEMA).alias("body"))
    rows = parsed.select(*keep, F.explode(F.col("body.observations")).alias("item"))
    return _typed(rows, keep, first, last)


def read_observations(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Landed payload files, one per series, named ``<series_id>.json``."""
    payloads = spark.read.json(path, schema=PAYLOAD_SCHEMA, multiLine=True)
    series_id = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json", 1)
    rows = payloads.select(series_id.alias("series_id"), F.explode("observations").alias("item"))
    return _typed(rows, ("series_id",), first, last)


def _typed(rows: DataFrame, keep: tuple[str, ...], first: str | None, last: str | None) -> DataFrame:
    typed = rows.select(
        *keep, strict_date(F.col("item.date")).alias("date"), to_number(F.col("item.value")).alias("value")
    )
    if first is not None:
        typed = typed.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        typed = typed.filter(F.col("date") <= F.lit(last).cast("date"))
    return typed


def name_series(observations: DataFrame, catalogue: dict[str, str], series_id: str = "series_id") -> DataFrame:
    """Keep catalogued series and add their column name (name -> id mapping)."""
    name: Column | None = None
    for column, identifier in catalogue.items():
        hit = F.col(series_id) == identifier
        name = F.when(hit, F.lit(column)) if name is None else name.when(hit, F.lit(column))
    return observations.filter(F.col(series_id).isin(*catalogue.values())).withColumn("series", name)
