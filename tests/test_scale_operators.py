"""Operators for heavy keys, long series and stored summaries."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators.distributions import binned_density, density
from tidemark.operators.features import feature_columns, lag_features
from tidemark.operators.fill import fill_in_order, with_order_chunks
from tidemark.operators.importance import permutation_importance
from tidemark.operators.joins import heavy_keys, merge_heavy, merge_two
from tidemark.operators.permute import permuted_rank
from tidemark.operators.sketches import merged_sketches, month_sketches
from tidemark.plans.panel import CleanOptions, build_panel
from tidemark.sources.exports import read_table_csv


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", ["outer", "inner", "left", "right"])
def test_heavy_merge_equals_the_plain_one(spark, how):
    draw = random.Random(3)

    def side(n, hot, alone):
        keys = [hot if draw.random() < 0.35 else alone if draw.random() < 0.2 else draw.choice([None, *range(60)]) for _ in range(n)]
        return [(k, draw.choice(["x", None]), i) for i, k in enumerate(keys)]

    left = spark.createDataFrame(side(900, None, 500), "k int, j string, v int").repartition(4)
    right = spark.createDataFrame(side(40, 7, 600) + [(None, None, 99), (None, "x", 98)], "k int, j string, v int").repartition(3)
    want = merge_two(left, right, ["k", "j"], how)
    for share in (0.05, 0.2):
        got = merge_heavy(left, right, ["k", "j"], how, share=share, salts=5)
        assert got.columns == want.columns and listed(got) == listed(want)
    assert heavy_keys(left, ["k", "j"], 0.1) and not heavy_keys(left.limit(0), ["k", "j"], 0.1)
    assert listed(merge_heavy(left.limit(0), right, ["k", "j"], how)) == listed(merge_two(left.limit(0), right, ["k", "j"], how))


def test_a_heavy_key_spreads_over_tasks(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(-1, "a"), (4, "b")], "k long, s string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = merge_heavy(left, right, ["k"], "outer")
        places = merged.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in places) == 3000 and len(places) >= 4
    assert max(r["count"] for r in places) < 1500


@pytest.mark.parametrize("size", [1, 2, 3, 10, 37, 400])
def test_keyed_permutation(spark, size):
    df = spark.range(size).crossJoin(spark.range(3).withColumnRenamed("id", "k"))
    placed = df.select("k", "id", permuted_rank(F.col("id"), F.lit(size), F.col("k").cast("string")).alias("at")).collect()
    for k in range(3):
        assert sorted(r["at"] for r in placed if r.k == k) == list(range(size))
    if size > 30:
        assert len({tuple(r["at"] for r in sorted(placed, key=lambda r: r.id) if r.k == k) for k in range(3)}) == 3


def test_importance_gathers_no_series(spark):
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(i), float(i % 7), bool(i % 2), 3.0 * (i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "s string, d date, u double, b boolean, y double")
    predict = lambda r: r.withColumn("prediction", 3 * F.col("u") + F.when(F.col("b"), 0.0).otherwise(0.0))
    found = permutation_importance(df, predict, ["u", "b"], "s", "d", "y", repeats=3)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    got = {r.feature: r for r in found.collect()}
    assert got["u"].importance_mean == pytest.approx(2, rel=0.1) and got["b"].importance_mean == 0
    again = permutation_importance(df.repartition(5), predict, ["u", "b"], "s", "d", "y", repeats=3)
    assert {r.feature: r.importance_mean for r in again.collect()} == pytest.approx({k: v.importance_mean for k, v in got.items()})


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6])
def test_binned_density_keeps_its_bound(spark, tolerance):
    draw = np.random.default_rng(2)
    values = [("a", float(v)) for v in draw.normal(50, 9, 1500)] + [("b", float(v)) for v in draw.lognormal(0, 1, 400)]
    values += [("flat", 1.0)] * 5 + [("one", 2.0), ("a", None)]
    df = spark.createDataFrame(values, "g string, v double")
    exact = {(r.g, r.point): r for r in density(df, "g", "v").collect()}
    binned = {(r.g, r.point): r for r in binned_density(df, "g", "v", tolerance=tolerance).collect()}
    assert {g for g, _ in binned} == {"a", "b"}
    for g in "ab":
        own = np.array([v for k, v in values if k == g and v is not None])
        bound = 1.01 * tolerance / (len(own) ** -0.2 * own.std(ddof=1) * math.sqrt(2 * math.pi))
        for point in range(200):
            near = binned[g, point].density if (g, point) in binned else 0.0
            assert abs(near - exact[g, point].density) <= bound
    assert len(exact) == 400


def test_merged_sketches_stay_within_their_error(spark):
    n = 60_000
    rows = spark.range(n).select(
        (F.col("id") % 2).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("d"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("v"), (F.col("id") % 9000).alias("who"),
    )
    stored = month_sketches(rows, ["k"], "d", "v", "who", k=256)
    out = {r.k: r for r in merged_sketches(stored, ["k"], {"mid": 0.5, "high": 0.95}, k=256).collect()}
    for k in (0, 1):
        own = np.sort([r.v for r in rows.filter(F.col("k") == k).select("v").collect()])
        assert out[k].n == len(own) and out[k].least == own[0] and out[k].most == own[-1]
        assert out[k].distinct == pytest.approx(4500, rel=0.02)
        for name, p in (("mid", 0.5), ("high", 0.95)):
            assert abs(np.searchsorted(own, out[k][name]) / len(own) - p) < 2.3 / 256**0.9
    assert merged_sketches(stored.limit(0), ["k"], {"mid": 0.5}).count() == 0


def test_calendar_lags_need_the_month(spark):
    dates = [dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 2, 20), dt.date(2020, 4, 1), dt.date(2021, 1, 1), None]
    df = spark.createDataFrame([("s", d, float(10 + i)) for i, d in enumerate(dates)], "s string, d date, y double")
    got = {r.d: r for r in lag_features(df, "s", "d", "y", (1, 2, 12), (1, 2), calendar=True).collect()}
    assert got[dates[1]].y_lag_1 == got[dates[2]].y_lag_1 == 10 and got[dates[3]].y_lag_1 is None
    assert got[dates[3]].y_lag_2 == 11.5 and got[dates[4]].y_lag_12 == 10 and got[dates[4]].y_seasonal_diff == 4
    assert got[dates[1]].y_roll_mean_1 == 10 and got[dates[3]].y_roll_mean_2 is None and got[None].y_lag_1 is None


def test_flags_are_numbers(spark):
    df = spark.createDataFrame([(True, 1.0, "x")], "flag boolean, v double, c string")
    assert feature_columns(df, [], "v") == (["flag"], ["c"])


def test_a_frequent_order_value_is_cut_without_a_tie_column(spark):
    rows = [(5 if i % 3 else i, None if i % 4 else i, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "o int, v int, i int")
    sizes = [r["count"] for r in with_order_chunks(df, "o", chunks=8).groupBy("_chunk").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / 8
    filled = fill_in_order(df, ["v"], "o", chunks=8).collect()
    known = {r.i: r.v for r in filled}
    assert len(filled) == 6000 and all(r.v is not None for r in filled)
    assert all(known[i] == v for _, v, i in rows if v is not None)


def test_a_large_csv_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text("a,b\n" + "".join(f"{i},text {i}\n" for i in range(40_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        split = read_table_csv(spark, str(path), "a int, b string", multi_line=False)
        assert split.rdd.getNumPartitions() > 3 and split.agg(F.sum("a")).first()[0] == 40_000 * 39_999 // 2
        assert read_table_csv(spark, str(path), "a int, b string").count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unread_values_are_counted(spark):
    rows = [("c", "2020-01-05", "3", "$5.00", "x, United States"), ("c", "soon", "3", "$5.00", "x, United States"),
            ("c", "2020-01-07", "many", "on request", "x, United States"), ("c", " ", "", None, "x"), (None, "2020-02-30", "1", "1", "x")]
    courses = spark.createDataFrame(rows, "`Course Type Name` string, `Start Date` string, Enrolled string, `Student Price` string, Location string")
    students = spark.createDataFrame([("1", "c", "2020-01-05"), ("2", "c", "?"), (None, "c", "?")], "ID string, `Course Type Name` string, `Course Start Date` string")
    seen, met = Observation("courses"), Observation("students")
    panel = build_panel(courses, students, CleanOptions(), course_counts=seen, student_counts=met)
    assert panel.select("enrolled", "num_students").collect() == [(3.0, 1)]
    assert seen.get == {"rows": 5, "unread_dates": 2, "unread_enrolled": 1, "unread_student_price": 1}
    assert met.get == {"rows": 2, "unread_dates": 1}
