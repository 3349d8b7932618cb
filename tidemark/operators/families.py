"""Model families: what a candidate of a family fits and predicts, and the search over all of them.

A family is registered under a name and then takes part in search, refit, forecast and
importance. Every family yields the same kind of model, a linear part and a sum of
trees, which Spark evaluates natively from the columns ``intercept``, ``weights`` and
``trees``. Fitting works on one (series, fold) at a time inside a grouped map; groups
are no larger than the calendar and independent, so any number of series spreads over
the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ensembles import Tree, boosted, forest, shown, staged_boosting, staged_forest
from tidemark.operators.linear import (
    LINEAR_CANDIDATES,
    Candidate,
    Moments,
    grid,
    moments_of,
    solve_moments,
    spread_groups,
)
from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)

# Fixed candidate grids.
FOREST_GRID = {"n_estimators": (50, 100, 200), "max_depth": (None, 5, 10, 20)}
BOOST_GRID = {"n_estimators": (100, 200, 300), "learning_rate": (0.01, 0.05, 0.1), "max_depth": (3, 4, 6)}
HIST_GRID = {"max_iter": (100, 200, 400), "learning_rate": (0.01, 0.05, 0.1), "max_depth": (3, 4, 6)}

TREE_CANDIDATES = [
    *grid("random_forest", FOREST_GRID),
    *grid("gbr", BOOST_GRID),
    *grid("hgb", HIST_GRID),
]
ALL_CANDIDATES = [*LINEAR_CANDIDATES, *TREE_CANDIDATES]
TREE_TYPE = "struct<feature: array<int>, cut: array<double>, child: array<int>, value: array<double>, depth: int>"
MODEL_SCHEMA = f"intercept double, weights array<double>, trees array<{TREE_TYPE}>, converged boolean"


@dataclass
class Model:
    """``intercept + weights . x +`` the value that each tree reaches; ``converged`` is false where a
    solver gave up."""

    intercept: float
    weights: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    converged: bool = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        seen = shown(x)
        return self.intercept + x @ self.weights + sum(t.walk(seen) for t in self.trees)


@dataclass(frozen=True)
class Family:
    """``fit(x, y, candidates)`` gives one model per candidate. ``predict(x, y, rows, candidates)``, if
    given, gives their predictions for ``rows`` at less cost. ``from_moments(moments, candidates)``, if
    given, fits from sums over the training rows, and the search then copies no rows. ``untuned`` is the
    candidate for runs without a search."""

    name: str
    fit: Callable[[np.ndarray, np.ndarray, Sequence[Candidate]], list[Model]]
    predict: Callable[[np.ndarray, np.ndarray, np.ndarray, Sequence[Candidate]], np.ndarray] | None = None
    untuned: Candidate | None = None
    from_moments: Callable[[Moments, Sequence[Candidate]], list[Model]] | None = None

    def predictions(self, x, y, rows, candidates: Sequence[Candidate]) -> np.ndarray:
        if self.predict is not None:
            return self.predict(x, y, rows, candidates)
        return np.stack([m.predict(rows) for m in self.fit(x, y, candidates)])


FAMILIES: dict[str, Family] = {}


def register_family(family: Family) -> None:
    FAMILIES[family.name] = family


def families_of(candidates: Sequence[Candidate]) -> dict[str, Family]:
    """The families that the candidates need; they travel with the tasks."""
    unknown = sorted({c.family for c in candidates} - set(FAMILIES))
    if unknown:
        raise ValueError(f"unknown model families: {', '.join(unknown)}")
    return {c.family: FAMILIES[c.family] for c in candidates}


def untuned_candidates() -> list[Candidate]:
    """One candidate per family, for runs without a search."""
    return [f.untuned for f in FAMILIES.values() if f.untuned is not None]


# The families of the fixed grids ------------------------------------------------


def _linear_from_moments(moments: Moments, candidates: Sequence[Candidate]) -> list[Model]:
    intercepts, weights, converged = solve_moments(moments, candidates)
    return [Model(float(i), w, [], bool(c)) for i, w, c in zip(intercepts, weights, converged)]


def _linear_fit(x: np.ndarray, y: np.ndarray, candidates: Sequence[Candidate]) -> list[Model]:
    return _linear_from_moments(moments_of(x, y), candidates)


def _scaled(tree: Tree, scale: float) -> Tree:
    return Tree(tree.feature, tree.cut, tree.child, [v * scale for v in tree.value], tree.depth)


def _forest_fit(x, y, candidates: Sequence[Candidate]) -> list[Model]:
    models = []
    for candidate in candidates:
        p = dict(candidate.params)
        trees = forest(x, y, p["n_estimators"], p.get("max_depth"))
        models.append(Model(0.0, np.zeros(x.shape[1]), [_scaled(t, 1 / len(trees)) for t in trees]))
    return models


def _forest_predict(x, y, rows, candidates: Sequence[Candidate]) -> np.ndarray:
    params = [dict(c.params) for c in candidates]
    return staged_forest(x, y, rows, [(p["n_estimators"], p.get("max_depth")) for p in params])


def _boosting(size: str, histogram: bool) -> tuple[Callable, Callable]:
    """Fit and staged predictions; ``size`` names the parameter that counts the trees."""

    def fit(x, y, candidates: Sequence[Candidate]) -> list[Model]:
        models = []
        for candidate in candidates:
            p = dict(candidate.params)
            trees = boosted(x, y, p[size], p["learning_rate"], p["max_depth"], histogram)
            scaled = [_scaled(t, p["learning_rate"]) for t in trees]
            models.append(Model(float(y.mean()), np.zeros(x.shape[1]), scaled))
        return models

    def predict(x, y, rows, candidates: Sequence[Candidate]) -> np.ndarray:
        params = [dict(c.params) for c in candidates]
        out = np.empty((len(candidates), len(rows)))
        for rate, depth in {(p["learning_rate"], p["max_depth"]) for p in params}:
            shared = [i for i, p in enumerate(params) if (p["learning_rate"], p["max_depth"]) == (rate, depth)]
            out[shared] = staged_boosting(x, y, rows, [params[i][size] for i in shared], rate, depth, histogram)
        return out

    return fit, predict


# The untuned candidates.
register_family(
    Family("ridge", _linear_fit, untuned=Candidate("ridge", (("alpha", 1.0),)), from_moments=_linear_from_moments)
)
register_family(
    Family(
        "elasticnet", _linear_fit, untuned=Candidate("elasticnet", (("alpha", 1.0), ("l1_ratio", 0.5))),
        from_moments=_linear_from_moments,
    )
)
register_family(
    Family(
        "random_forest", _forest_fit, _forest_predict,
        Candidate("random_forest", (("n_estimators", 100), ("max_depth", None))),
    )
)
register_family(
    Family(
        "gbr", *_boosting("n_estimators", False),
        Candidate("gbr", (("n_estimators", 100), ("learning_rate", 0.1), ("max_depth", 3))),
    )
)
register_family(
    Family(
        "hgb", *_boosting("max_iter", True),
        Candidate("hgb", (("max_iter", 100), ("learning_rate", 0.1), ("max_depth", None))),
    )
)


# Search and refit over all series -------------------------------------------------


def _matrix(group: pd.DataFrame) -> np.ndarray:
    return np.stack(group["features"].to_numpy())


def cross_predict(
    matrix: DataFrame, series: str, date: str, target: str, candidates: Sequence[Candidate] = LINEAR_CANDIDATES
) -> DataFrame:
    """Fit every candidate on each (series, fold)'s training rows and predict its
    validation rows: (series, fold, date, model_name, actual, prediction)."""
    names = [series, "fold", date, "model_name", "actual", "prediction"]
    families = families_of(candidates)

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        # A fixed row order makes retried tasks repeat their sums exactly.
        group = group.sort_values(date, kind="stable")
        train, valid = group[group["role"] == "train"], group[group["role"] == "valid"]
        if train.empty or valid.empty:
            return pd.DataFrame(columns=names)
        x, y, rows = _matrix(train), train[target].to_numpy(float), _matrix(valid)
        labels, parts = [], []
        for name, family in families.items():
            own = [c for c in candidates if c.family == name]
            labels += [c.label for c in own]
            parts.append(family.predictions(x, y, rows, own))
        return pd.DataFrame(
            {
                series: group[series].iloc[0],
                "fold": group["fold"].iloc[0],
                date: np.tile(valid[date].to_numpy(), len(labels)),
                "model_name": np.repeat(labels, len(valid)),
                "actual": np.tile(valid[target].to_numpy(float), len(labels)),
                "prediction": np.concatenate(parts).ravel(),
            },
            columns=names,
        )

    types = dict(matrix.dtypes)
    schema = (
        f"`{series}` {types[series]}, fold int, `{date}` {types[date]}, "
        "model_name string, actual double, prediction double"
    )
    columns = [series, "fold", "role", date, target, "features"]
    groups = spread_groups(matrix.select(*columns), series, "fold")
    return groups.groupBy(series, "fold").applyInPandas(fit_group, schema)


def fit_models(
    matrix: DataFrame,
    series: str,
    date: str,
    target: str,
    candidates: Sequence[Candidate] = LINEAR_CANDIDATES,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Fit candidates on all rows of each series: ``model_name`` and the columns of ``MODEL_SCHEMA``.

    With ``chosen`` (series, model_name) only the chosen ones of each series are
    fitted, and series without one are left out.
    """
    by_label, some = {c.label: c for c in candidates}, chosen is not None
    families = families_of(candidates)

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(date, kind="stable")
        wanted = by_label if not some else set(group["_wanted"].iloc[0])
        x, y = _matrix(group), group[target].to_numpy(float)
        out = []
        for name, family in families.items():
            own = [c for label, c in by_label.items() if c.family == name and label in wanted]
            for candidate, model in zip(own, family.fit(x, y, own) if own else ()):
                trees = [asdict(t) for t in model.trees]
                out.append((group[series].iloc[0], candidate.label, model.intercept, model.weights, trees, model.converged))
        return pd.DataFrame(out, columns=[series, "model_name", "intercept", "weights", "trees", "converged"])

    kind = dict(matrix.dtypes)[series]
    schema = f"`{series}` {kind}, model_name string, {MODEL_SCHEMA}"
    rows = matrix.select(series, date, target, "features")
    if chosen is not None:
        known = chosen.filter(F.col("model_name").isin(list(by_label)))
        # At most one label per candidate and series.
        rows = rows.join(known.groupBy(series).agg(F.collect_set("model_name").alias("_wanted")), series)
    return spread_groups(rows, series).groupBy(series).applyInPandas(fit_group, schema)


def tree_value(tree: Column, features: Column) -> Column:
    """The value that a row's features reach in a tree, one step for each of its levels."""

    def step(at: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], at)
        # Trees compare features in single precision.
        value = F.get(features, feature).cast("float").cast("double")
        below = F.get(tree["child"], at) + F.when(value > F.get(tree["cut"], at), 1).otherwise(0)
        return F.when(feature < 0, at).otherwise(below)

    levels = F.when(tree["depth"] > 0, F.sequence(F.lit(1), tree["depth"])).otherwise(F.array().cast("array<int>"))
    return F.get(tree["value"], F.aggregate(levels, F.lit(0), step))


def model_prediction(features: Column, linear: Column, trees: Column) -> Column:
    """``linear`` plus the values that ``features`` reach in ``trees``."""
    return F.aggregate(trees, linear, lambda total, tree: total + tree_value(tree, features))
