"""Table access, comparison rounding and the query register."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


class Register:
    """Named queries in the order they were added."""

    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.entries[name] = Entry(run, sql)
            return run

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(value: Column, digits: int = 6) -> Column:
    """Round for comparison with the oracle.

    Means of money amounts often end in a 5 right after the last kept digit,
    where summation order decides the result; a small offset moves them off it.
    """
    offset = 2.5 * 10.0 ** -(digits + 2)
    return F.round(value + F.lit(offset), digits) + F.lit(0.0)


def fixed_all(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(F.col(c), digits) for c in columns})


def sql_fixed(value: str, digits: int = 6) -> str:
    """The same rounding in the oracle's SQL."""
    return f"(round(({value}) + {2.5 * 10.0 ** -(digits + 2)!r}, {digits}) + 0.0)"
