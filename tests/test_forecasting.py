"""Models, recursion, importance and whole runs on small panels."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linear
from tidemark.operators.folds import expanding_folds
from tidemark.operators.forecast import fold_forecast, future_stub, recent_history
from tidemark.operators.importance import permutation_importance
from tidemark.operators.linear import Candidate, LINEAR_CANDIDATES
from tidemark.operators.preprocess import FeatureSet, apply_preprocessor, fit_preprocessor
from tidemark.operators.families import TREE_CANDIDATES
from tidemark.plans.forecasting import ForecastSpec, PanelForecast
from tidemark.plans.reports import actual_and_forecast


def test_grid_sizes_and_labels():
    labels = [c.label for c in [*LINEAR_CANDIDATES, *TREE_CANDIDATES]]
    assert len(labels) == len(set(labels)) == 90
    assert "ridge_alpha=0.1" in labels and "elasticnet_alpha=0.01_l1_ratio=0.9" in labels
    assert "random_forest_n_estimators=50_max_depth=None" in labels
    assert "hgb_max_iter=400_learning_rate=0.05_max_depth=6" in labels


@pytest.fixture(scope="module")
def system():
    random = np.random.default_rng(3)
    x = random.normal(size=(60, 8))
    x[:, 7] = x[:, 6]  # perfectly correlated
    x[:, 5] = 0.0  # constant
    y = x @ np.array([3.0, -2, 0, 0, 1, 0, 2, 0]) + random.normal(size=60)
    return x, y


def test_ridge_solves_normal_equations(system):
    x, y = system
    intercepts, weights, _ = linear.solve(x, y, [Candidate("ridge", (("alpha", 2.0),))])
    residual = y - intercepts[0] - x @ weights[0]
    centred = x - x.mean(axis=0)
    np.testing.assert_allclose(centred.T @ residual, 2.0 * weights[0], atol=1e-8)
    assert abs(residual.mean()) < 1e-10


def plain_descent(x, y, l1, l2, sweeps=20_000):
    """Slow coordinate descent to convergence."""
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(len(w)):
            size = x[:, j] @ x[:, j]
            if size > 0:
                pull = x[:, j] @ (y - x @ w) + size * w[j]
                w[j] = np.sign(pull) * max(abs(pull) - l1, 0) / (size + l2)
    return w


def objective(x, y, w, l1, l2):
    return ((y - x @ w) ** 2).sum() / 2 + l1 * np.abs(w).sum() + l2 * (w @ w) / 2


@pytest.mark.parametrize("alpha,ratio", [(0.01, 0.9), (0.1, 0.5), (0.5, 0.1), (50.0, 0.9)])
def test_elastic_net_is_near_the_optimum(system, alpha, ratio):
    x, y = system
    xc, yc = x - x.mean(axis=0), y - y.mean()
    l1, l2 = alpha * ratio * len(y), alpha * (1 - ratio) * len(y)
    _, weights, _ = linear.solve(x, y, [Candidate("elasticnet", (("alpha", alpha), ("l1_ratio", ratio)))])
    best = objective(xc, yc, plain_descent(xc, yc, l1, l2, 3000), l1, l2)
    assert objective(xc, yc, weights[0], l1, l2) - best <= linear.TOLERANCE * (yc @ yc)


def test_preprocessor(spark):
    rows = [("a", 1.0, 5.0, None, "x"), ("a", 2.0, 5.0, None, "y"), ("a", 4.0, 5.0, None, None), ("a", None, 5.0, None, "y"),
            ("a", 9.0, 5.0, None, "x")]
    schema = "s string, u double, flat double, gone double, c string"
    features = FeatureSet(["u", "flat", "gone"], ["c"])
    train = spark.createDataFrame(rows, schema)
    fitted = fit_preprocessor(train, ["s"], features)
    new = spark.createDataFrame([("a", None, 5.0, 1.0, "z"), ("a", 3.0, 6.0, None, None)], schema)
    filled = np.array([1, 2, 4, 3, 9.0])
    got = [r.features for r in apply_preprocessor(new, fitted, ["s"], features, ["u"]).orderBy(F.col("u").isNull()).collect()]
    np.testing.assert_allclose(got[0], [(3 - filled.mean()) / filled.std(), 1.0, 0.0, 1.0, 0.0])
    np.testing.assert_allclose(got[1], [(3 - filled.mean()) / filled.std(), 0.0, 0.0, 0.0, 0.0])


@pytest.fixture(scope="module")
def panel(spark):
    """Two seasonal series of 60 months with gaps, and one that is too short."""
    random = np.random.default_rng(11)
    rows = []
    for s, size in (("long", 60), ("gappy", 60), ("short", 20)):
        for i in range(size):
            date = dt.date(2015 + i // 12, i % 12 + 1, 1)
            if s == "gappy" and date.month in (6, 7):
                continue
            level = 50 + 20 * np.sin(i / 12 * 2 * np.pi) + i + random.normal()
            target = None if i in (7, size - 1) else round(float(level), 2)
            rows.append((s, date, date.year, date.month, target, float(i % 7), "wet" if i % 3 else None, int(i > size - 4)))
    schema = "s string, date date, year int, month int, y double, x double, c string, covid_flag int"
    return spark.createDataFrame(rows, schema)


SPEC = ForecastSpec(series="s", date="date", target="y", end=None, trees=())


@pytest.fixture(scope="module")
def run(panel):
    return PanelForecast(panel, SPEC)


def test_future_rows(panel):
    stub = future_stub(panel, "s", "date", "y", 12, "2020-03-31").orderBy("s", "date").toPandas()
    assert list(stub[stub.s == "long"].date) == [dt.date(2020, m, 1) for m in (1, 2, 3)]
    assert stub.y.isna().all() and (stub.covid_flag == 0).all()
    assert (stub.month == [d.month for d in stub.date]).all() and (stub.year == [d.year for d in stub.date]).all()
    assert len(stub[stub.s == "short"]) == 12 and set(stub[stub.s == "long"].x) == {59 % 7}
    assert future_stub(panel, "s", "date", "y", 12, "2019-12-31").filter("s = 'long'").count() == 0


def test_results_skip_short_series(run):
    rows = run.results().toPandas()
    assert set(rows.s) == {"long", "gappy"} and len(rows) == 48
    assert rows.rmse_mean.gt(0).all()


def slow_forecast(run, series, label):
    """Month by month in pandas, rebuilding the features at every step."""
    spec = run.spec
    model = run.refit().filter((F.col("s") == series) & (F.col("model_name") == label)).first()
    fitted = run.parameters().filter(F.col("s") == series).first()
    work = run.panel.filter(F.col("s") == series).toPandas().sort_values("date").reset_index(drop=True)
    stub = future_stub(run.panel, "s", "date", "y", spec.horizon, spec.end).filter(F.col("s") == series).toPandas()
    work = pd.concat([work, stub.sort_values("date")], ignore_index=True)
    work["y"] = work["y"].astype(float)
    out = []
    for i in range(len(work) - len(stub), len(work)):
        y, date = work["y"], work["date"][i]
        values = {c: work[c][i] for c in ("x", "covid_flag")}
        quarter = (date.month - 1) // 3 + 1
        values |= {"year_num": date.year, "month_num": date.month, "quarter": quarter}
        for name, v, period in (("month", date.month, 12), ("quarter", quarter, 4)):
            values[f"{name}_sin"], values[f"{name}_cos"] = (f(2 * np.pi * v / period) for f in (np.sin, np.cos))
        for j, name in enumerate(("is_winter", "is_spring", "is_summer", "is_fall")):
            values[name] = int(date.month % 12 // 3 == j)
        values |= {f"y_lag_{k}": y.shift(k)[i] for k in (1, 2, 3, 12)}
        values |= {f"y_roll_mean_{w}": y.shift(1).rolling(w).mean()[i] for w in (3, 12)}
        values["y_seasonal_diff"] = np.nan
        vector = []
        for j, name in enumerate(run.features.numeric):
            v = values[name]
            v = fitted.medians[j] if pd.isna(v) else v
            vector.append((v - fitted.means[j]) / fitted.scales[j])
        label_value = work["c"][i] or fitted.modes[0]
        vector += [float(k == label_value) for k in fitted.categories[0]]
        prediction = max(model.intercept + float(np.dot(model.weights, vector)), 0.0)
        out.append(prediction)
        work.loc[i, "y"] = prediction
    return out


@pytest.mark.parametrize("series", ["long", "gappy"])
def test_recursion_matches_slow_loop(run, series):
    label = "ridge_alpha=1.0"
    got = run.forecast().filter((F.col("s") == series) & (F.col("model_name") == label)).orderBy("date").collect()
    np.testing.assert_allclose([r.prediction for r in got], slow_forecast(run, series, label), rtol=1e-9)


def test_persistence_when_no_lag_is_known(spark):
    months = [dt.date(2020, m, 1) for m in range(1, 13)]
    rows = [("known", d, 7.0 if d.month == 1 else None) for d in [dt.date(2019, 1, 1), *months]] + [("never", d, None) for d in months]
    df = spark.createDataFrame(rows, "s string, date date, y double").filter("date <> date'2020-01-01'")
    history = recent_history(df, "s", "date", "y", 2)
    steps = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.make_date(F.lit(2021), i, F.lit(1)).alias("date"), F.lit(1.0).alias("base")))
    plans = history.withColumn("steps", steps)
    out = fold_forecast(plans, ["s"], "y", {"y_lag_1": (F.lit(10.0), F.lit(0.0))}, lags=(1, 2), windows=(2,))
    assert [(r.s, r.prediction) for r in out.orderBy("date").collect()] == [("known", 7.0), ("known", 71.0), ("known", 711.0)]


def test_best_forecast_totals(run):
    results = run.results().cache()
    best = run.best(results).toPandas().set_index("s")
    frame = results.toPandas()
    for s, part in frame.groupby("s"):
        assert best.best_rmse[s] == part.rmse_mean.min()
    forecast = run.best_forecast(results).toPandas()
    assert len(forecast) == 24 and forecast.prediction.ge(0).all()
    assert (forecast.groupby("s").model_name.first() == best.best_model_name).all()
    annual = run.annual(run.best_forecast(results)).toPandas()
    assert annual.forecast_students.sum() == pytest.approx(forecast.prediction.sum())
    top = run.top_forecasts(results, 3)
    assert top.select("s", "model_name").distinct().count() == 6
    lines = actual_and_forecast(run.panel, top, "s", "date", "y")
    assert lines.filter("line = 'actual' and s = 'short'").count() == 0
    assert lines.filter("line <> 'actual'").count() == 72


def test_leaky_features_can_be_left_out(panel):
    run = PanelForecast(panel, ForecastSpec(series="s", target="y", trees=(), exclude_leaky=("x", "y_seasonal_diff")))
    assert not {"x", "y_seasonal_diff"} & set(run.features.names)


def test_target_must_exist(panel):
    with pytest.raises(ValueError):
        PanelForecast(panel, ForecastSpec(series="s", target="absent"))


def test_importance_against_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), *map(float, random.normal(size=2)), "ab"[i % 2]) for s in "pq" for i in range(30)]
    frame = pd.DataFrame(rows, columns=["s", "date", "u", "w", "c"])
    frame["y"] = 3 * frame.u + 0.1 * frame.w + (frame.c == "a")
    df = spark.createDataFrame(frame)

    def predict(rows):
        return rows.withColumn("prediction", 3 * F.col("u") + (F.col("c") == "a").cast("double"))

    got = permutation_importance(df, predict, ["u", "w", "c"], "s", "date", "y", 40)
    again = permutation_importance(df.repartition(5), predict, ["u", "w", "c"], "s", "date", "y", 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    got = got.toPandas().set_index(["s", "feature"])
    for s, part in frame.groupby("s"):
        spread = ((part.y - part.y.mean()) ** 2).sum()
        # Expected drop of a shuffled column: twice its term's variance, less noise.
        want = 2 * 9 * part.u.var(ddof=0) * len(part) / spread
        assert got.importance_mean[s, "u"] == pytest.approx(want, rel=0.25)
        assert got.importance_mean[s, "w"] == 0 and got.importance_std[s, "w"] == 0
        assert 0 < got.importance_mean[s, "c"] < got.importance_mean[s, "u"]


# A quick look at each family of trees.
SMALL_TREE_CANDIDATES = [
    Candidate("random_forest", (("n_estimators", 20), ("max_depth", 5))),
    Candidate("gbr", (("n_estimators", 10), ("learning_rate", 0.1), ("max_depth", 3))),
    Candidate("hgb", (("max_iter", 10), ("learning_rate", 0.1), ("max_depth", 3))),
]


def test_tree_models(panel):
    run = PanelForecast(
        panel, ForecastSpec(series="s", target="y", end=None, linear=(), trees=SMALL_TREE_CANDIDATES, min_train=20, valid=8, horizon=3)
    )
    results = run.results().toPandas()
    assert set(results.model_name) == {c.label for c in SMALL_TREE_CANDIDATES}
    # Far better than a spread-free guess of zero.
    assert results.rmse_mean.max() < 60
    forecast = run.forecast().toPandas()
    assert len(forecast) == 2 * 3 * 3 and forecast.prediction.between(0, 200).all()


def test_no_series_with_enough_history(panel):
    few = panel.filter("s = 'short'")
    run = PanelForecast(few, ForecastSpec(series="s", target="y", end=None, trees=SMALL_TREE_CANDIDATES[:1]))
    assert run.results().count() == 0


def test_saved_tables(spark, panel, tmp_path):
    ridge = tuple(c for c in LINEAR_CANDIDATES if c.family == "ridge")
    stump = Candidate("gbr", (("n_estimators", 2), ("learning_rate", 0.1), ("max_depth", 2)))
    run = PanelForecast(
        panel,
        ForecastSpec(series="s", target="y", end=None, linear=ridge, trees=(stump,), horizon=4),
    )
    run.save(str(tmp_path))
    tables = {p.name: spark.read.csv(str(p), header=True, inferSchema=True) for p in tmp_path.iterdir()}
    assert set(tables) == {"model_results", "best_models", "monthly_forecast", "annual_forecast", "feature_importance"}
    # "short" has no row in any table but the others have one per candidate, month and feature.
    assert tables["model_results"].count() == 2 * 5 and tables["best_models"].count() == 2
    assert tables["monthly_forecast"].count() == 2 * 4
    total = tables["monthly_forecast"].agg(F.sum("prediction")).first()[0]
    assert tables["annual_forecast"].agg(F.sum("forecast_students")).first()[0] == pytest.approx(total)
    assert tables["feature_importance"].count() == 2 * len(run.features.names)
    # Importance of a tree model, for a series as if it had won.
    chosen = spark.createDataFrame([("long", stump.label)], "s string, model_name string")
    scores = run.importance(chosen, repeats=2)
    assert {r.s for r in scores.collect()} == {"long"} and scores.agg(F.max("importance_mean")).first()[0] > 0
