"""The fitted workloads search whole grids."""

from __future__ import annotations

import pytest

from tidemark.operators.families import ALL_CANDIDATES, TREE_CANDIDATES, untuned_candidates
from tidemark.operators.linear import LINEAR_CANDIDATES
from tidemark.plans.forecasting import ForecastSpec
from workloads import panels


class Stop(Exception):
    """Carries the settings of a run."""


@pytest.mark.parametrize(
    "query, linear, trees",
    [
        (panels.tree_cv, [], TREE_CANDIDATES),
        (panels.tree_forecast, [], TREE_CANDIDATES),
        (panels.best_linear_forecast, LINEAR_CANDIDATES, []),
        (panels.importance, LINEAR_CANDIDATES, []),
    ],
)
def test_whole_grids(monkeypatch, query, linear, trees):
    def stop(spark, sf_dir, **settings):
        raise Stop(ForecastSpec(**settings))

    monkeypatch.setattr(panels, "order_forecast", stop)
    with pytest.raises(Stop) as found:
        query(None, "")
    spec = found.value.args[0]
    assert list(spec.linear) == list(linear) and list(spec.trees) == list(trees)
    assert (spec.min_train, spec.valid) == (ForecastSpec().min_train, ForecastSpec().valid)


def test_the_default_search_is_the_whole_grid():
    assert ForecastSpec().candidates == ALL_CANDIDATES and len(ALL_CANDIDATES) == 90
    untuned = ForecastSpec(tuning=False).candidates
    assert untuned == untuned_candidates()
    assert [c.family for c in untuned] == ["ridge", "elasticnet", "random_forest", "gbr", "hgb"]
