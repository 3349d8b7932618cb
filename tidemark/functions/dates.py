"""Date parsing, month arithmetic, flags and cyclic encodings."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Export date layouts, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd",
    "yyyy/M/d",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "M/d/yyyy",
    "M/d/yy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
)

# Meteorological seasons by month number.
SEASONS = {
    "is_winter": (12, 1, 2),
    "is_spring": (3, 4, 5),
    "is_summer": (6, 7, 8),
    "is_fall": (9, 10, 11),
}


def layout_pattern(layout: str) -> str:
    """Regular expression of the texts that a date layout can read."""
    pattern = ""
    for run in re.findall(r"'[^']*'|y+|M+|S+|[dHhms]+?(?=[^dHhms]|$)|a|.", layout):
        letter = run[0]
        if letter == "'":
            pattern += re.escape(run.strip("'"))
        elif letter in "yS":
            pattern += rf"\d{{{len(run)}}}"
        elif letter == "M" and len(run) > 2:
            pattern += r"\p{L}+"
        elif letter in "MdHhms":
            pattern += r"\d{2}" if len(run) == 2 else r"\d{1,2}"
        elif letter == "a":
            pattern += "[AaPp][Mm]"
        else:
            pattern += re.escape(letter)
    return f"^{pattern}$"


def parse_timestamp(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Coercing parse: the first layout that fits, else null.

    A layout is only tried on text of its shape, since a failed parse costs an
    exception per row.
    """
    trimmed = F.trim(text)
    return F.coalesce(
        *[F.when(trimmed.rlike(layout_pattern(f)), F.try_to_timestamp(trimmed, F.lit(f))) for f in formats]
    )


def strict_date(text: Column) -> Column:
    """Cast to a date; under ANSI mode bad input fails the job instead of hiding."""
    return text.cast("date")


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def month_start_from(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def next_month_start(date: Column) -> Column:
    return F.add_months(month_start(date), 1)


def month_sequence(first: Column, last: Column) -> Column:
    """Array of month starts from first to last; empty when first is later."""
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(F.array().cast("array<date>"))


def between_flag(date: Column, first: str, last: str) -> Column:
    """1 inside the closed date interval, else 0."""
    inside = date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.coalesce(inside.cast("int"), F.lit(0))


def since_flag(date: Column, first: str) -> Column:
    """1 on and after the date, else 0."""
    return F.coalesce((date >= F.lit(first).cast("date")).cast("int"), F.lit(0))


def member_flag(value: Column, members: Sequence[int]) -> Column:
    return F.coalesce(value.isin(*members).cast("int"), F.lit(0))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats after ``period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def earliest(dates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: F.least(a, b), dates)
