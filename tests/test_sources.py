"""Readers, guards and writers."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans.panel import COURSE_COLUMNS, LOCATION_COLUMNS, STUDENT_COLUMNS, CleanOptions, build_panel
from tidemark.functions.text import numbered_course_rules
from tidemark.sources.exports import read_export_folder, read_table_csv, require_columns
from tidemark.sources.observations import name_series, observations_from_json, read_observations
from tidemark.sources.pages import label_pages, read_page_files
from tidemark.sources.sinks import write_csv, write_parquet, write_per_series

COURSES_A = """Course Type Name,Start Date,Enrolled,Student Price,Location
Level 1,2018-01-05,10,$400.00,"Town, CO, United States"
 LEVEL 1 + rescue ,2018-01-20,x,"$1,400.00","Town, CO, United States"
Level 1,not a date,5,$1.00,"Town, CO, United States"
,2018-01-07,5,$1.00,"Town, CO, United States"
Level 2,2016-12-01,7,,"Town, CO, United States"
"Level
2",2018-02-01,3,300,"Oslo, Norway"
"""
COURSES_B = '''Note,Location,Student Price,Enrolled,Start Date,Course Type Name
"a, ""b""","Town, UT, United States",$500.00,4,1/9/2018,level 1
'''
STUDENTS = """ID,Course Type Name,Course Start Date
1,Level 1,2018-01-05
,Level 1,2018-01-06
3,Level 2,2018-03-06
"""


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "a.csv": COURSES_A,
        "b.csv": COURSES_B,
        "students.csv": STUDENTS,
        "other.csv": "x,y\n1,2\n",
        "notes.txt": "Course Type Name",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_folder_guard(spark, folder):
    courses = read_export_folder(spark, folder, LOCATION_COLUMNS)
    assert courses.count() == 7
    assert {r.source_file.rsplit("/", 1)[1] for r in courses.select("source_file").collect()} == {"a.csv", "b.csv"}
    assert courses.filter(F.col("Course Type Name").contains("\n")).count() == 1


def test_folder_errors(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        read_export_folder(spark, folder, ["missing column"])
    with pytest.raises(FileNotFoundError):
        read_export_folder(spark, str(tmp_path / "nowhere"), COURSE_COLUMNS)
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        read_export_folder(spark, str(empty), COURSE_COLUMNS)


def test_panel_from_exports(spark, folder):
    options = CleanOptions(rules=numbered_course_rules("level"))
    panel = build_panel(
        read_export_folder(spark, folder, LOCATION_COLUMNS), read_export_folder(spark, folder, STUDENT_COLUMNS), options
    )
    rows = [tuple(r) for r in panel.collect()]
    # 400, 500 and 1400 trimmed to the middle one; 2016 is too early.
    assert rows == [
        (2, 2018, "level\n2", 3.0, None, None),
        (1, 2018, "level 1", 14.0, 1, 500.0),
        (3, 2018, "level 2", None, 1, None),
    ]


def test_observations(spark):
    bodies = [
        ("a", json.dumps({"observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-02-01", "value": "."}]})),
        ("b", json.dumps({"observations": []})),
        ("c", "{}"),
    ]
    payloads = spark.createDataFrame(bodies, "id string, body string")
    rows = observations_from_json(payloads, "body", ("id",))
    assert sorted(map(tuple, rows.collect())) == [("a", dt.date(2020, 1, 1), 1.5), ("a", dt.date(2020, 2, 1), None)]
    none = observations_from_json(payloads.filter("id <> 'a'"), "body", ("id",))
    assert none.count() == 0 and none.dtypes == [("id", "string"), ("date", "date"), ("value", "double")]


def test_observation_files(spark, tmp_path):
    for name in ("AAA", "BBB", "CCC"):
        body = {"observations": [{"date": f"202{i}-01-01", "value": str(i)} for i in range(4)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    rows = name_series(read_observations(spark, str(tmp_path), "2021-01-01", "2022-12-31"), {"first": "AAA", "third": "CCC"})
    assert sorted({r.series for r in rows.collect()}) == ["first", "third"] and rows.count() == 4


def test_pages(spark, tmp_path):
    (tmp_path / "page_2018.html").write_text("<p>Outlook: La Niña is near.</p><p>Discussion: El Niño</p>", encoding="utf-8")
    (tmp_path / "page_2019.html").write_text("<p>Empty</p>", encoding="utf-8")
    pages = read_page_files(spark, str(tmp_path)).unionByName(spark.createDataFrame([("2020", None)], "key string, html string"))
    got = sorted(map(tuple, label_pages(pages, ["key"]).collect()))
    assert got == [("2018", "La Niña", "La Niña is near."), ("2019", "Unknown", ""), ("2020", "ERROR", "")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"", 1, "x"), ("line\nbreak", 2, "y z")], "t string, n int, s string")
    write_csv(df, str(tmp_path / "csv"))
    write_csv(df, str(tmp_path / "csv"))
    assert sorted(read_table_csv(spark, str(tmp_path / "csv"), df.schema).collect()) == sorted(df.collect())
    write_parquet(df, str(tmp_path / "parquet"), ["s"])
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    write_per_series(df, str(tmp_path / "series"), "s")
    assert {p.name for p in (tmp_path / "series").glob("s=*")} == {"s=x", "s=y z"}


def test_missing_column(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["target"])


def test_optional_column_is_null_where_a_file_lacks_it(spark, folder, tmp_path):
    (tmp_path / "c.csv").write_text("Course Type Name,Start Date,Enrolled,Student Price\nLevel 1,2018-01-05,10,$400.00\n")
    found = read_export_folder(spark, folder, COURSE_COLUMNS, optional=["Location"])
    assert found.count() == 8
    lacking = found.filter(F.col("source_file").endswith("c.csv")).collect()
    assert [r.Location for r in lacking] == [None]


def test_header_of_any_length_and_with_line_breaks(spark, tmp_path):
    names = ['"two\nlines"', *[f"column {i} " + "x" * 50 for i in range(3000)], "Start Date"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join("v" for _ in names) + "\n")
    (tmp_path / "small.csv").write_text("Start Date\n2018-01-05\n")
    found = read_export_folder(spark, str(tmp_path), ["Start Date"])
    assert sorted(r[0] for r in found.select("`Start Date`").collect()) == ["2018-01-05", "v"]


def test_rows_are_ordered_by_file_and_place(spark, tmp_path):
    """Spark packs large files first and each layout is a scan of its own; the order is by path all the same."""
    head = "Course Type Name,Start Date,Enrolled,Student Price"
    for name, start, rows in (("a file.csv", head, 3), ("b.csv", head, 4000), ("c.csv", "Note," + head, 2)):
        extra = "n," if start.startswith("Note") else ""
        lines = [f"{extra}{name} {i},2018-01-05,1,$1.00" for i in range(rows)]
        (tmp_path / name).write_text("\n".join([start, *lines]) + "\n")
    for multi_line in (True, False):
        found = read_export_folder(spark, str(tmp_path), COURSE_COLUMNS, multi_line=multi_line)
        names = [r[0] for r in found.orderBy("source_row").select("`Course Type Name`").collect()]
        wanted = [f"a file.csv {i}" for i in range(3)] + [f"b.csv {i}" for i in range(4000)] + [f"c.csv {i}" for i in range(2)]
        assert names == wanted
