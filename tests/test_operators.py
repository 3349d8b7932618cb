"""Operators against brute force, with a hot key holding a third of the rows."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.operators.distributions import density, histogram
from tidemark.operators.features import lag_features, usable_rows
from tidemark.operators.fill import fill_by_date, fill_in_order, with_order_chunks
from tidemark.operators.folds import expanding_folds, history_gate
from tidemark.operators.joins import join_group_values, merge_on_keys
from tidemark.operators.quantiles import group_quantiles, trimmed_mean
from tidemark.operators.rollup import aggregate_to_month, monthly_rollup, most_frequent, rollup
from tidemark.operators.selection import best_models, best_per_group, top_per_group
from tidemark.operators.series import pct_change, zscores


@pytest.fixture(scope="module")
def skewed():
    """6000 rows: a third in one group, heavy ties and some nulls."""
    random = np.random.default_rng(7)
    n = 6000
    group = np.where(random.random(n) < 0.34, "hot", np.char.add("g", random.integers(0, 40, n).astype(str)))
    value = np.round(random.lognormal(3, 1, n), 1)
    value[random.random(n) < 0.2] = 5.0
    frame = pd.DataFrame({"id": np.arange(n), "g": group, "v": value})
    frame.loc[random.random(n) < 0.05, "v"] = np.nan
    return frame


def to_spark(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, g string, v double")


@pytest.mark.parametrize("accuracy", [100, 1000, 100_000])
def test_quantiles(spark, skewed, accuracy):
    # Low accuracy makes even these groups use narrow brackets.
    points = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = group_quantiles(to_spark(spark, skewed), ["g"], "v", points, accuracy).toPandas().set_index("g")
    want = skewed.groupby("g")["v"].quantile(list(points.values())).unstack()
    for name, p in points.items():
        np.testing.assert_allclose(got[name].sort_index(), want[p].sort_index(), rtol=1e-12)


def test_trimmed_mean(spark, skewed):
    df = to_spark(spark, skewed).withColumn("m", F.col("id") % 3)
    got = trimmed_mean(df, "g", "v", ["m", "g"], digits=None).toPandas().set_index(["m", "g"])["mean_v"].sort_index()
    frame = skewed.assign(m=skewed["id"] % 3).dropna()
    low, high = (frame.groupby("g")["v"].transform(lambda s, p=p: s.quantile(p)) for p in (0.05, 0.95))
    want = frame[(frame.v >= low) & (frame.v <= high)].groupby(["m", "g"])["v"].mean()
    pd.testing.assert_series_equal(got, want.sort_index(), check_names=False, check_index_type=False)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_group_values_join_either_way(spark, skewed, limit):
    df = to_spark(spark, skewed)
    groups = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    joined = join_group_values(df, groups, ["g"], limit=limit)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == (limit > 0)
    assert joined.count() == len(skewed)


@pytest.mark.parametrize("chunks", [2, 7, 64])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_fill(spark, skewed, chunks, keys):
    frame = skewed.copy()
    frame.loc[frame.id < 40, "v"] = np.nan
    frame.loc[frame.id.between(1000, 2500), "v"] = np.nan
    got = fill_in_order(to_spark(spark, frame), ["v"], "id", keys, chunks=chunks).toPandas().sort_values("id")
    want = frame.groupby("g")["v"].transform(lambda s: s.ffill().bfill()) if keys else frame["v"].ffill().bfill()
    np.testing.assert_allclose(got["v"].to_numpy(), want.to_numpy())
    assert list(got.columns) == ["id", "g", "v"]


def test_fill_with_tied_order(spark, skewed):
    df = to_spark(spark, skewed).withColumn("day", (F.col("id") / 500).cast("int"))
    got = fill_in_order(df, ["v"], "day", tie=["id"], chunks=5).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].to_numpy(), skewed["v"].ffill().bfill().to_numpy())


def test_chunks_share_the_rows(spark, skewed):
    sizes = with_order_chunks(to_spark(spark, skewed), "id", chunks=8).groupBy("_chunk").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 1.2 * len(skewed) / 8


def test_fill_with_a_third_of_the_rows_on_one_day(spark, skewed):
    day = F.when(F.col("g") == "hot", F.lit(3000)).otherwise(F.col("id"))
    df = to_spark(spark, skewed).withColumn("day", day)
    sizes = with_order_chunks(df, "day", ["id"], 8).groupBy("_chunk").count().toPandas()["count"]
    assert sizes.max() < 1.3 * len(skewed) / 8
    got = fill_in_order(df, ["v"], "day", tie=["id"], chunks=8).toPandas().set_index("id")["v"]
    frame = skewed.assign(day=np.where(skewed.g == "hot", 3000, skewed.id)).sort_values(["day", "id"])
    want = frame.set_index("id")["v"].ffill().bfill()
    np.testing.assert_allclose(got.sort_index(), want.sort_index())


def test_fill_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert [r.v for r in fill_in_order(df, ["v"], "id").collect()] == [None, None]


def test_fill_by_date(spark):
    rows = [(dt.date(2017, m, 1), s, None if m in (1, 4) else f"L{m}") for m in range(1, 6) for s in "ab"]
    df = spark.createDataFrame(rows, "date date, s string, label string")
    got = {(r.date.month, r.s): r.label for r in fill_by_date(df, ["label"], "date").collect()}
    assert [got[m, "a"] for m in range(1, 6)] == ["L2", "L2", "L3", "L3", "L5"] and len(got) == 10


def test_histogram(spark, skewed):
    got = histogram(to_spark(spark, skewed), "g", "v", 30).toPandas()
    for g, part in skewed.dropna().groupby("g"):
        counts, _ = np.histogram(part.v, bins=30)
        have = got[got.g == g].set_index("bin")["count"].reindex(range(1, 31), fill_value=0)
        # Values on an edge may fall either side of it in floating point.
        assert have.sum() == counts.sum() and np.abs(have.to_numpy() - counts).sum() <= 4


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, v double")
    assert [(r.bin, r["count"]) for r in histogram(df, "g", "v").collect()] == [(1, 2)]


def test_density(spark, skewed):
    got = density(to_spark(spark, skewed), "g", "v", 50).toPandas()
    for g, part in skewed.dropna().groupby("g"):
        v = part.v.to_numpy()
        h = len(v) ** -0.2 * v.std(ddof=1)
        x = np.linspace(v.min(), v.max(), 50)
        want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        have = got[got.g == g].set_index("point")["density"].reindex(range(50), fill_value=0.0)
        np.testing.assert_allclose(have, want, rtol=1e-9, atol=1e-15)


def test_merge_matches_null_keys_and_renames(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (None, "m")], "k int, v string")
    rows = merge_on_keys([a, b], ["k"]).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(1, "x", None), (2, None, "y"), (None, "n", "m")]))
    assert merge_on_keys([a, b], ["k"], "inner").columns == ["k", "v_x", "v_y"]
    for bad in ([], ["k"]), ([a], []):
        with pytest.raises(ValueError):
            merge_on_keys(*bad)
    with pytest.raises(ValueError):
        merge_on_keys([a, b], ["k"], "cross")


def test_rollups_on_nulls(spark):
    rows = [(None, 1.0, "a", 9), ("k", None, None, 1), ("k", None, "z", 3), ("k", None, "y", 2), ("j", 2.0, "q", 4)]
    df = spark.createDataFrame(rows, "k string, v double, t string, o int")
    named = dict(sums={"s": "v"}, means={"m": "v"}, counts={"c": "v"})
    out = rollup(df, ["k"], **named, firsts={"f": "t"}, first_order="o").orderBy("k").collect()
    assert [tuple(r) for r in out] == [("j", 2.0, 2.0, 1, "q"), ("k", 0.0, None, 0, "y")]
    plain = rollup(df, ["k"], **named).orderBy("k").collect()
    assert [tuple(r) for r in plain] == [("j", 2.0, 2.0, 1), ("k", 0.0, None, 0)]
    assert [r.t for r in most_frequent(df.filter("k = 'k'"), ["k"], "t").collect()] == ["y"]


def test_month_aggregates(spark):
    day = lambda m, d: dt.date(2020, m, d)
    rows = [(day(1, 1), 1.0), (day(1, 9), 3.0), (day(1, 20), None), (day(2, 1), None), (None, 5.0)]
    df = spark.createDataFrame(rows, "date date, v double")
    got = {a: [r.v for r in aggregate_to_month(df, "v", a).orderBy("month").collect()] for a in ("mean", "sum", "last")}
    assert got == {"mean": [2.0, None], "sum": [4.0, 0.0], "last": [3.0, None]}
    with pytest.raises(ValueError):
        aggregate_to_month(df, "v", "median")


def test_hot_series_panel_is_calendar_sized(spark, skewed):
    df = to_spark(spark, skewed).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")))
    panel = monthly_rollup(df, "d", ["g"], counts={"n": "id"})
    assert panel.groupBy("g").count().agg(F.max("count")).first()[0] <= 24
    assert panel.agg(F.sum("n")).first()[0] == len(skewed)


def monthly(spark, targets, skip=()):
    dates = [d.date() for d in pd.date_range("2015-01-01", periods=len(targets) + len(skip), freq="MS")]
    kept = [d for i, d in enumerate(dates) if i not in skip]
    return spark.createDataFrame([("s", d, t) for d, t in zip(kept, targets)], "s string, date date, y double")


def test_lags_count_rows_not_months(spark):
    targets = [float(i) for i in range(20)]
    targets[5] = None
    got = lag_features(monthly(spark, targets, skip=(3, 4)), "s", "date", "y").toPandas().sort_values("date")
    y = pd.Series(targets, dtype=float)
    for k in (1, 2, 3, 12):
        np.testing.assert_allclose(got[f"y_lag_{k}"], y.shift(k))
    for w in (3, 12):
        np.testing.assert_allclose(got[f"y_roll_mean_{w}"].astype(float), y.shift(1).rolling(w).mean())
    np.testing.assert_allclose(got["y_seasonal_diff"].astype(float), y - y.shift(12))


def test_folds(spark):
    usable = usable_rows(lag_features(monthly(spark, [float(i) for i in range(46)]), "s", "date", "y"), "y")
    assert usable.count() == 34
    folds = expanding_folds(usable, "s", "date").toPandas()
    assert sorted(folds.fold.unique()) == [0, 1, 2]
    for number, fold in folds.groupby("fold"):
        train, valid = fold[fold.role == "train"], fold[fold.role == "valid"]
        assert len(train) == 24 + 3 * number and len(valid) == 3 and train.date.max() < valid.date.min()


def test_short_series_is_gated(spark):
    usable = usable_rows(lag_features(monthly(spark, [float(i) for i in range(38)]), "s", "date", "y"), "y")
    assert [r.is_kept for r in history_gate(usable, "s", "date").collect()] == [False]
    assert expanding_folds(usable, "s", "date").count() == 0


def test_percent_change_does_not_pad(spark):
    df = monthly(spark, [float(i + 1) if i != 2 else None for i in range(16)])
    got = [r.y_yoy_pct for r in pct_change(df, "y", ["date"]).orderBy("date").collect()]
    assert got[:12] == [None] * 12 and got[12] == pytest.approx(1200) and got[14] is None


def test_zscores(spark, skewed):
    got = zscores(to_spark(spark, skewed), ["v"]).toPandas().sort_values("id")["v_z"].astype(float)
    want = (skewed.v - skewed.v.mean()) / skewed.v.std()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_best_rows_put_nulls_last(spark):
    rows = [("s", "m1", None, 1.0, 1.0), ("s", "m2", 2.0, 5.0, 1.0), ("s", "m3", 2.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "s string, model_name string, rmse_mean double, mae_mean double, mape_mean double")
    assert best_models(df, "s").first().best_model_name == "m3"
    assert best_per_group(df, ["s"], ["rmse_mean"]).columns == df.columns


def test_top_rows_are_cut_before_the_shuffle(spark, skewed):
    top = top_per_group(to_spark(spark, skewed), ["g"], [F.col("v").desc_nulls_last(), "id"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(3)
    assert sorted(r.id for r in top.collect()) == sorted(want.id)


def test_top_groups_break_ties_by_key(spark):
    df = spark.createDataFrame([(k, 1.0) for k in "bbaacd"], "k string, v double")
    assert [r.k for r in joins.top_groups(df, "k", "v", 3).collect()] == ["a", "b", "c"]
