"""Coercing number parsers and arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number with optional exponent. Java's parser would also take
# a type suffix ("1d") and "NaN", which a coercing parse must turn into null.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def to_number_or_zero(text: Column) -> Column:
    return F.coalesce(to_number(text), F.lit(0.0))


def currency_to_number(text: Column) -> Column:
    """``$1,390.00`` to 1390.0: keep digits, dots and minus signs, then parse."""
    return to_number(F.regexp_replace(text, r"[^0-9.\-]", ""))


def to_integer(value: Column) -> Column:
    return value.cast("int")


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Scale, round half to even, unscale, all in binary floating point."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip_at_zero(value: Column) -> Column:
    """Negative values become 0; null stays null (``greatest`` would skip it)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def safe_zscore(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, or 0.0 on every row when std is null or zero."""
    return F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise((value - mean) / std)


def interpolate(lower: Column, upper: Column, fraction: Column) -> Column:
    return lower + (upper - lower) * fraction
