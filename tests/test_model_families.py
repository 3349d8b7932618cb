"""Trees, boosting and the registry of model families."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ensembles, families
from tidemark.operators.ensembles import Grower
from tidemark.operators.families import FAMILIES, TREE_CANDIDATES, Family, Model, model_prediction, register_family
from tidemark.operators.features import calendar_features
from tidemark.operators.forecast import future_stub
from tidemark.operators.linear import Candidate
from tidemark.plans.forecasting import ForecastSpec, PanelForecast


def rows_of(n, p, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, p))
    x[:, p // 2 :] = np.round(x[:, p // 2 :])
    return x, 20 * x[:, 0] - 7 * x[:, -1] + draw.normal(size=n), draw.normal(size=(9, p))


def brute_split(x, y, w, least=1):
    """The least squared error that one cut leaves, by trying them all."""
    best = math.inf
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            error = sum(
                float(w[side] @ (y[side] - np.average(y[side], weights=w[side])) ** 2) for side in (left, ~left)
            )
            best = min(best, error)
    return best


@pytest.mark.parametrize("weighted, least", [(False, 1), (True, 1), (False, 5)])
def test_a_cut_lowers_the_error_most(weighted, least):
    for seed in range(8):
        x, y, _ = rows_of(25, 4, seed)
        w = np.random.default_rng(seed).integers(0, 3, 25).astype(float) if weighted else np.ones(25)
        tree, reached = Grower(x).grow(y, w if weighted else None, 1, least)
        used = w > 0
        error = float(w[used] @ (y[used] - reached[used]) ** 2)
        assert error == pytest.approx(brute_split(ensembles.shown(x)[used], y[used], w[used], least))
        assert tree.depth == 1 and len(tree.feature) == 3


def test_full_trees_meet_every_row_and_respect_limits():
    x, y, _ = rows_of(60, 6, 1)
    tree, reached = Grower(x).grow(y)
    assert reached == pytest.approx(y) and tree.walk(ensembles.shown(x)) == pytest.approx(y)
    shallow, _ = Grower(x).grow(y, depth=2)
    assert shallow.depth == 2 and sum(f < 0 for f in shallow.feature) <= 4
    assert tree.walk(ensembles.shown(x), 2) == pytest.approx(shallow.walk(ensembles.shown(x)))
    few, _ = Grower(x).grow(y, least=20, leaves=3, gainful=True)
    assert sum(f < 0 for f in few.feature) <= 3
    sizes = np.unique(few.walk(ensembles.shown(x)), return_counts=True)[1]
    assert sizes.min() >= 20
    flat, _ = Grower(x).grow(np.full(60, 3.0))
    assert flat.feature == [-1] and flat.value == [3.0]


def test_first_trees_of_one_ensemble_equal_separate_fits():
    """Every candidate of the grids, on one fit for each rate and depth, against a fit of its own."""
    x, y, rows = rows_of(45, 5, 2)
    small = {"n_estimators": {50: 3, 100: 6, 200: 11, 300: 14}, "max_iter": {100: 4, 200: 8, 400: 13}}
    for name in ("random_forest", "gbr", "hgb"):
        own = [
            Candidate(c.family, tuple((k, small.get(k, {}).get(v, v)) for k, v in c.params))
            for c in TREE_CANDIDATES if c.family == name
        ]
        together = FAMILIES[name].predictions(x, y, rows, own)
        alone = [FAMILIES[name].fit(x, y, [c])[0].predict(rows) for c in own]
        assert together.shape == (len(own), len(rows))
        if name == "random_forest":
            # A limited tree stops drawing ties earlier, so only full forests are equal in every draw.
            full = [i for i, c in enumerate(own) if dict(c.params)["max_depth"] is None]
            assert together[full] == pytest.approx(np.stack(alone)[full])
            assert np.abs(together - np.stack(alone)).max() < y.std()
        else:
            assert together == pytest.approx(np.stack(alone))


def test_spark_evaluates_models_like_the_library(spark):
    x, y, rows = rows_of(70, 5, 3)
    candidates = [
        Candidate("random_forest", (("n_estimators", 7), ("max_depth", None))),
        Candidate("gbr", (("n_estimators", 9), ("learning_rate", 0.1), ("max_depth", 4))),
        Candidate("hgb", (("max_iter", 9), ("learning_rate", 0.1), ("max_depth", 3))),
        Candidate("ridge", (("alpha", 1.0),)),
    ]
    for candidate in candidates:
        (model,) = FAMILIES[candidate.family].fit(x, y, [candidate])
        trees = [(t.feature, t.cut, t.child, t.value, t.depth) for t in model.trees]
        data = [(i, [float(v) for v in r], model.intercept, [float(v) for v in model.weights], trees) for i, r in enumerate(rows)]
        df = spark.createDataFrame(
            data, f"i int, features array<double>, intercept double, weights array<double>, trees array<{families.TREE_TYPE}>"
        )
        linear = F.col("intercept") + F.aggregate(
            F.zip_with("features", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
        )
        got = df.select("i", model_prediction(F.col("features"), linear, F.col("trees")).alias("p")).orderBy("i").collect()
        assert [r.p for r in got] == pytest.approx(list(model.predict(rows)))


def months(n):
    return [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture
def panel(spark):
    draw = np.random.default_rng(4)
    rows = [
        (s, d, d.year, d.month, 50 + 20 * math.sin(i / 2) + float(draw.normal()) + 5 * k)
        for k, s in enumerate("ab") for i, d in enumerate(months(60))
    ]
    return spark.createDataFrame(rows, "s string, date date, year int, month int, y double")


def spec(**settings):
    return ForecastSpec(series="s", target="y", **{"linear": (), "trees": (), "horizon": 4, **settings})


def test_a_family_from_outside_takes_part_everywhere(panel):
    def fit(x, y, candidates):
        """The mean of the target and a share of what the strongest feature adds."""
        strongest = int(np.abs(x.T @ (y - y.mean())).argmax())
        models = []
        for c in candidates:
            weights = np.zeros(x.shape[1])
            weights[strongest] = dict(c.params)["share"] * y.std()
            models.append(Model(float(y.mean()), weights))
        return models

    candidates = tuple(Candidate("strongest", (("share", v),)) for v in (0.25, 0.75))
    with pytest.raises(ValueError, match="unknown model families: strongest"):
        PanelForecast(panel, spec(others=candidates)).results()
    register_family(Family("strongest", fit, untuned=candidates[0]))
    try:
        run = PanelForecast(panel, spec(others=candidates))
        results = run.results()
        assert {r.model_name for r in results.collect()} == {c.label for c in candidates}
        best = run.best(results).withColumnRenamed("best_model_name", "model_name")
        assert run.forecast(best).count() == 2 * 4
        scores = run.importance(best, repeats=2).collect()
        assert {r.s for r in scores} == {"a", "b"} and max(r.importance_mean for r in scores) > 0
        assert len(PanelForecast(panel, spec(tuning=False)).grid()) == 6
    finally:
        del FAMILIES["strongest"]


def test_tree_recursion_matches_a_loop(panel):
    """Month by month with the fitted model itself, lags filled by medians where unknown."""
    stump = Candidate("gbr", (("n_estimators", 12), ("learning_rate", 0.1), ("max_depth", 3)))
    run = PanelForecast(panel, spec(trees=(stump,), exclude_leaky=("y_seasonal_diff",)))
    forecast = {(r.s, r.date): r.prediction for r in run.forecast().collect()}
    assert len(forecast) == 8
    names = run.features.numeric
    models = {r.s: r for r in run.refit().collect()}
    parameters = {r.s: r for r in run.parameters().collect()}
    stub = calendar_features(future_stub(panel, "s", "date", "y", 4), "date").collect()
    stub = {(r.s, r.date): r.asDict() for r in stub}
    for s in "ab":
        history = [r.y for r in panel.filter(F.col("s") == s).orderBy("date").collect()]
        model, learned = models[s], parameters[s]
        trees = [ensembles.Tree(*t) for t in model.trees]
        for step in range(4):
            date = dt.date(2020, step + 1, 1)
            values = dict(stub[s, date])
            values |= {f"y_lag_{k}": history[-k] for k in (1, 2, 3, 12)}
            values |= {f"y_roll_mean_{w}": sum(history[-w:]) / w for w in (3, 12)}
            x = [(values[n] - m) / sd for n, m, sd in zip(names, learned.means, learned.scales)]
            value = Model(model.intercept, np.array(model.weights), trees).predict(np.array([x]))[0]
            history.append(max(value, 0.0))
            assert forecast[s, date] == pytest.approx(history[-1])


def test_solvers_that_give_up_are_marked(monkeypatch, panel):
    from tidemark.operators import linear

    net = Candidate("elasticnet", (("alpha", 0.01), ("l1_ratio", 0.5)))
    x, y, _ = rows_of(40, 6, 5)
    assert FAMILIES["elasticnet"].fit(x, y, [net])[0].converged
    monkeypatch.setattr(linear, "MAX_SWEEPS", 1)
    assert not FAMILIES["elasticnet"].fit(x, y, [net])[0].converged
    assert "converged" in PanelForecast(panel, spec(linear=(net,))).refit().columns
