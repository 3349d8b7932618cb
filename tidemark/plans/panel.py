"""Raw exports to the monthly panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.dates import DATE_FORMATS, parse_timestamp
from tidemark.functions.numbers import currency_to_number, to_number
from tidemark.functions.text import KeyRule, canonical_key, last_part
from tidemark.operators.joins import merge_on_keys
from tidemark.operators.quantiles import trimmed_mean
from tidemark.operators.rollup import monthly_rollup
from tidemark.session import keep_table

# Fixed column names of the exports and of the panel.
COURSE_COLUMNS = ("Course Type Name", "Start Date", "Enrolled", "Student Price")
LOCATION_COLUMNS = (*COURSE_COLUMNS, "Location")
STUDENT_COLUMNS = ("ID", "Course Type Name", "Course Start Date")
SERIES = "combined_course"
MONTH_KEYS = ("month", "year", SERIES)
HOME_COUNTRY = "United States"
FIRST_YEAR = 2017


@dataclass(frozen=True)
class CleanOptions:
    """Key rules, date layouts and an optional earliest date."""

    rules: Sequence[KeyRule] = ()
    formats: Sequence[str] = DATE_FORMATS
    min_date: str | None = None


def _unread(text: Column, parsed: Column) -> Column:
    """How many texts that hold something could not be read."""
    return F.count_if(F.trim(text).isNotNull() & (F.trim(text) != "") & parsed.isNull())


def _named(
    rows: DataFrame,
    date: str,
    options: CleanOptions,
    counts: Observation | None = None,
    parsed: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Parse the date and the ``parsed`` columns, add the course key and drop rows lacking date or key.

    ``counts`` takes what could not be read in the same scan: ``rows``, ``unread_dates`` and
    ``unread_<column>`` of each ``parsed`` column, which is given as its text column and its value.
    """
    # Column names differ in case only, so parsed columns take the texts' places after the count.
    values = {f"_read_{name}": value for name, (_, value) in (parsed or {}).items()}
    named = rows.withColumns(
        {
            "course": F.col("`Course Type Name`"),
            "start_date": parse_timestamp(F.col(f"`{date}`"), options.formats),
            **values,
        }
    )
    if counts is not None:
        unread = {"dates": (date, "start_date")} | {n: (text, f"_read_{n}") for n, (text, _) in (parsed or {}).items()}
        metrics = [_unread(F.col(f"`{t}`"), F.col(c)).alias(f"unread_{n}") for n, (t, c) in unread.items()]
        named = named.observe(counts, F.count(F.lit(1)).alias("rows"), *metrics)
    named = named.filter(F.col("course").isNotNull() & F.col("start_date").isNotNull())
    if options.min_date is not None:
        named = named.filter(F.col("start_date") > F.lit(options.min_date).cast("timestamp"))
    named = named.withColumns({n: F.col(f"_read_{n}") for n in parsed or {}}).drop(*values)
    # With a name the key is never null; saying so spares later null checks on it.
    return named.withColumn(SERIES, F.coalesce(canonical_key(F.col("course"), options.rules), F.lit("")))


def clean_courses(
    rows: DataFrame, options: CleanOptions = CleanOptions(), counts: Observation | None = None
) -> DataFrame:
    """Typed course rows: dates, keys, enrolment (0 when unreadable) and price."""
    parsed = {
        "enrolled": ("Enrolled", to_number(F.col("Enrolled"))),
        "student_price": ("Student Price", currency_to_number(F.col("`Student Price`"))),
    }
    named = _named(rows, "Start Date", options, counts, parsed)
    return named.withColumn("enrolled", F.coalesce("enrolled", F.lit(0.0)))


def clean_students(
    rows: DataFrame, options: CleanOptions = CleanOptions(), counts: Observation | None = None
) -> DataFrame:
    return _named(rows.filter(F.col("ID").isNotNull()), "Course Start Date", options, counts)


def enrollment_by_month(courses: DataFrame) -> DataFrame:
    """Enrolled sum, mean price and first raw name per (month, year, series)."""
    order = "source_row" if "source_row" in courses.columns else None
    out = monthly_rollup(
        courses,
        "start_date",
        [SERIES],
        sums={"enrolled": "enrolled"},
        means={"student_price": "student_price"},
        firsts={"course": "course"},
        first_order=order,
    )
    return out.select("month", "year", SERIES, "enrolled", "student_price", "course")


def students_by_month(students: DataFrame) -> DataFrame:
    out = monthly_rollup(students, "start_date", [SERIES], counts={"num_students": "ID"})
    return out.select("month", "year", SERIES, "num_students")


def with_country(rows: DataFrame, location: str = "Location") -> DataFrame:
    """Country is the last comma part of the location; empty without the column."""
    if location not in rows.columns:
        return rows.withColumn("country", F.lit(""))
    return rows.withColumn("country", last_part(F.col(location)))


def home_prices(
    courses: DataFrame,
    country: str = HOME_COUNTRY,
    low: float = 0.05,
    high: float = 0.95,
    digits: int | None = 2,
) -> DataFrame:
    """Trimmed monthly mean price of courses in one country."""
    local = with_country(courses).filter(F.col("country") == country)
    priced = local.withColumns({"year": F.year("start_date"), "month": F.month("start_date")})
    return trimmed_mean(
        priced, SERIES, "student_price", ["year", "month", SERIES], low, high, "mean_student_price", digits
    )


def merge_panel(
    enrollment: DataFrame, students: DataFrame, prices: DataFrame, first_year: int = FIRST_YEAR
) -> DataFrame:
    """Outer merge of the monthly tables from ``first_year`` on.

    The year filter sits below the merge: above it, it would read the coalesced
    key and no scan could use it. Year is a join key, so the result is the same.
    """
    frames = [enrollment.select(*MONTH_KEYS, "enrolled"), students, prices]
    recent = [f.filter(F.col("year") >= first_year) for f in frames]
    return merge_on_keys(recent, list(MONTH_KEYS))


def build_panel(
    course_rows: DataFrame,
    student_rows: DataFrame,
    options: CleanOptions = CleanOptions(),
    country: str = HOME_COUNTRY,
    first_year: int = FIRST_YEAR,
    digits: int | None = 2,
    course_counts: Observation | None = None,
    student_counts: Observation | None = None,
) -> DataFrame:
    """Raw course and student rows to the monthly panel, ordered by series and month.

    The observations, if given, hold the numbers of unread dates, prices and enrolments
    (``unread_*``) and of ``rows``, counted while the rows are cleaned: those of the courses
    are there on return, those of the students once the panel has been computed.

    The cleaned course rows feed the rollup and the three passes of the trimmed
    mean, so their few columns are written once instead of parsing the exports
    again for each.
    """
    courses = clean_courses(course_rows, options, course_counts)
    kept = (SERIES, "course", "start_date", "enrolled", "student_price", "Location", "source_row")
    courses = keep_table(courses.select(*[c for c in kept if c in courses.columns]))
    students = clean_students(student_rows, options, student_counts)
    located = courses.filter(F.col("Location").isNotNull()) if "Location" in courses.columns else courses
    panel = merge_panel(
        enrollment_by_month(courses),
        students_by_month(students),
        home_prices(located, country, digits=digits),
        first_year,
    )
    return panel.orderBy(SERIES, "year", "month")
