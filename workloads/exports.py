"""Export folders written from the tables, scanned back and turned into a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import KeyRule
from tidemark.plans.panel import (
    COURSE_COLUMNS,
    LOCATION_COLUMNS,
    STUDENT_COLUMNS,
    CleanOptions,
    build_panel,
    clean_courses,
    enrollment_by_month,
    students_by_month,
    clean_students,
)
from tidemark.session import keep_table, shared_folder
from tidemark.sources.exports import read_export_folder, read_table_csv
from tidemark.sources.sinks import write_csv, write_per_series
from workloads.base import Register, fixed, sql_fixed, table

register = Register()

OPTIONS = CleanOptions(
    rules=(KeyRule(r"small\s*w", "widget", "widget 1"), KeyRule(r"large\s*w", "widget", "widget 2")),
    formats=("M/d/yyyy", "yyyy-MM-dd"),
)


def course_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as raw course exports: messy names, dates, prices and places."""
    lineitem = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = supplier.join(nation, "s_nationkey").join(region, "n_regionkey")
    rows = lineitem.join(part, "p_partkey").join(places.select("l_suppkey", "n_name", "r_name"), "l_suppkey")
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
    day = F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd"))
    price = F.when(F.col("l_tax") > 0, F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return rows.select(
        F.when(F.col("l_discount") < 0.1, name.otherwise(F.col("p_name"))).alias("Course Type Name"),
        day.otherwise(F.date_format("l_shipdate", "M/d/yyyy")).alias("Start Date"),
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("string")).otherwise("many").alias("Enrolled"),
        price.otherwise("").alias("Student Price"),
        F.concat_ws(", ", F.lit("Main St"), "n_name", "r_name").alias("Location"),
    )


def student_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw student exports."""
    lineitem = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    rows = lineitem.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return rows.select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).alias("ID"),
        F.col("p_name").alias("Course Type Name"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd").alias("Course Start Date"),
    )


SERIES_SQL = r"""
    CASE WHEN regexp_matches(p_name, 'small\s*w') AND contains(p_name, 'widget') THEN 'widget 1'
         WHEN regexp_matches(p_name, 'large\s*w') AND contains(p_name, 'widget') THEN 'widget 2' ELSE p_name END
"""
COURSES_SQL = f"""
    c AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year,
                 {SERIES_SQL} AS combined_course,
                 CASE WHEN l_quantity <= 40 THEN l_quantity ELSE 0 END AS enrolled,
                 CASE WHEN l_tax > 0 THEN l_extendedprice END AS price, r_name
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
               JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          WHERE l_discount < 0.1)
"""
STUDENTS_SQL = f"""
    s AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year,
                 {SERIES_SQL} AS combined_course, count(*) AS num_students
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 7 GROUP BY ALL)
"""


@register.add(
    "panel_from_exports",
    f"""
    WITH {COURSES_SQL}, {STUDENTS_SQL},
    b AS (SELECT combined_course, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi
          FROM c WHERE r_name = 'EUROPE' AND price IS NOT NULL GROUP BY combined_course),
    p AS (SELECT month, year, combined_course, {sql_fixed("avg(price)", 2)} AS mean_student_price
          FROM c JOIN b USING (combined_course)
          WHERE r_name = 'EUROPE' AND price BETWEEN lo AND hi GROUP BY ALL),
    e AS (SELECT month, year, combined_course, sum(enrolled) AS enrolled FROM c GROUP BY ALL)
    SELECT month, year, combined_course, enrolled, num_students, mean_student_price
    FROM (SELECT * FROM e WHERE year >= 1997) FULL JOIN (SELECT * FROM s WHERE year >= 1997)
             USING (month, year, combined_course)
         FULL JOIN (SELECT * FROM p WHERE year >= 1997) USING (month, year, combined_course)
    """,
)
def panel_from_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to the merged monthly panel: rollups, trimmed mean, outer merge."""
    panel = build_panel(course_rows(spark, sf_dir), student_rows(spark, sf_dir), OPTIONS, "EUROPE", 1997, digits=None)
    return panel.withColumn("mean_student_price", fixed(F.col("mean_student_price"), 2))


@register.add(
    "folder_scan_rollup",
    f"""
    WITH {COURSES_SQL}, {STUDENTS_SQL},
    e AS (SELECT month, year, combined_course, sum(enrolled) AS enrolled, {sql_fixed("avg(price)", 4)} AS student_price
          FROM c GROUP BY ALL)
    SELECT month, year, combined_course, enrolled, student_price, num_students
    FROM e JOIN s USING (month, year, combined_course)
    """,
)
def folder_scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports written as CSV files of several layouts in one folder, read back
    with the required-column guard, cleaned and rolled up."""
    folder = shared_folder(spark, "exports")
    courses, students = course_rows(spark, sf_dir), student_rows(spark, sf_dir)
    low = F.col("`Student Price`") == ""
    layouts = {
        # A layout without the optional column.
        "courses-a": courses.filter(low).drop("Location"),
        "courses-b": courses.filter(~low).select("Location", F.lit("x, \"y\"").alias("Note"), *LOCATION_COLUMNS[:4]),
        "students": students,
        "other": table(spark, sf_dir, "nation"),
    }
    for name, rows in layouts.items():
        write_csv(rows, f"{folder}/{name}")
    found = f"{folder}/*"
    enrolled = enrollment_by_month(clean_courses(read_export_folder(spark, found, COURSE_COLUMNS, optional=["Location"]), OPTIONS))
    counted = students_by_month(clean_students(read_export_folder(spark, found, STUDENT_COLUMNS), OPTIONS))
    out = enrolled.drop("course").join(counted, ["month", "year", "combined_course"])
    return out.withColumn("student_price", fixed(F.col("student_price"), 4))


@register.add(
    "unread_counts",
    """
    SELECT 'courses' AS source, count(*) AS rows, count(*) FILTER (l_linenumber = 7) AS unread_dates,
           count(*) FILTER (l_quantity > 40) AS unread_enrolled, count(*) FILTER (l_linenumber = 6) AS unread_student_price
    FROM lineitem
    UNION ALL
    SELECT 'students', count(*), count(*) FILTER (l_linenumber = 5), NULL, NULL FROM lineitem WHERE l_linenumber < 7
    """,
)
def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read while a panel was built, with planted dates and prices that no layout fits."""
    key = table(spark, sf_dir, "lineitem")
    day, price = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_extendedprice").cast("string")
    courses = key.select(
        F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string")).alias("Course Type Name"),
        F.when(F.col("l_linenumber") == 7, "soon").otherwise(day).alias("Start Date"),
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("string")).otherwise("many").alias("Enrolled"),
        F.when(F.col("l_linenumber") == 6, "on request").when(F.col("l_linenumber") == 5, " ").otherwise(price).alias("Student Price"),
        F.lit("Main St, United States").alias("Location"),
    )
    students = key.select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).alias("ID"),
        F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string")).alias("Course Type Name"),
        F.when(F.col("l_linenumber") == 5, "1 Smarch").otherwise(day).alias("Course Start Date"),
    )
    seen = {"courses": Observation("courses"), "students": Observation("students")}
    panel = build_panel(
        courses, students, OPTIONS, first_year=1990, course_counts=seen["courses"], student_counts=seen["students"]
    )
    keep_table(panel)
    names = ["rows", "unread_dates", "unread_enrolled", "unread_student_price"]
    rows = [(source, *[seen[source].get.get(n) for n in names]) for source in seen]
    return spark.createDataFrame(rows, "source string, " + ", ".join(f"{n} long" for n in names))


@register.add("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read back by as many tasks as its files have splits."""
    folder = f"{shared_folder(spark, 'csv')}/customer"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    write_csv(rows, folder)
    return read_table_csv(spark, folder, rows.schema, multi_line=False)


@register.add(
    "per_series_files",
    "SELECT n_name AS series, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def per_series_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files for every series, read back."""
    folder = f"{shared_folder(spark, 'csv')}/series"
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("series"))
    rows = table(spark, sf_dir, "customer").join(names, "c_nationkey").select("series", "c_custkey", "c_acctbal")
    write_per_series(rows, folder, "series")
    return read_table_csv(spark, folder, "c_custkey long, c_acctbal double, series string").select(*rows.columns)
