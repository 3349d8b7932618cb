"""Search, refit, explain and forecast every series of a panel in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.expanding import cross_predict_expanding
from tidemark.operators.features import feature_columns, panel_features, usable_rows
from tidemark.operators.folds import MIN_TRAIN_MONTHS, VALID_MONTHS, expanding_folds, history_gate
from tidemark.operators.forecast import HORIZON_MONTHS, annual_forecast, recursive_forecast
from tidemark.operators.importance import permutation_importance
from tidemark.operators.families import (
    TREE_CANDIDATES,
    cross_predict,
    families_of,
    fit_models,
    model_prediction,
    untuned_candidates,
)
from tidemark.operators.joins import stack_frames
from tidemark.operators.linear import LINEAR_CANDIDATES, Candidate, linear_prediction
from tidemark.operators.preprocess import FeatureSet, apply_preprocessor, feature_vector, fit_preprocessor
from tidemark.operators.selection import METRICS, best_models, fold_metrics, grid_place, mean_metrics, top_per_group
from tidemark.session import ensure_checkpoint_dir, keep_table
from tidemark.sources.exports import require_columns
from tidemark.sources.sinks import write_csv, write_per_series


@dataclass(frozen=True)
class ForecastSpec:
    """Columns and settings of a forecasting run.

    The search goes over the linear candidates, the tree candidates and ``others`` of
    registered families; without ``tuning`` over one candidate of every family.
    """

    series: str = "combined_course"
    date: str = "date"
    target: str = "num_students"
    min_train: int = MIN_TRAIN_MONTHS
    valid: int = VALID_MONTHS
    horizon: int = HORIZON_MONTHS
    end: str | None = None
    exclude_leaky: Sequence[str] = ()
    linear: Sequence[Candidate] = field(default_factory=lambda: tuple(LINEAR_CANDIDATES))
    trees: Sequence[Candidate] = field(default_factory=lambda: tuple(TREE_CANDIDATES))
    others: Sequence[Candidate] = ()
    tuning: bool = True

    @property
    def candidates(self) -> list[Candidate]:
        return [*self.linear, *self.trees, *self.others] if self.tuning else untuned_candidates()


class PanelForecast:
    """The steps of one run over one panel.

    The panel, a rollup far smaller than its source, is written once to the
    checkpoint folder, so no later step goes back to the raw rows. The steps
    themselves are lazy.
    """

    def __init__(self, panel: DataFrame, spec: ForecastSpec = ForecastSpec()):
        require_columns(panel, [spec.series, spec.date, spec.target])
        ensure_checkpoint_dir(panel.sparkSession)
        self.spec = spec
        dated = panel.filter(F.col(spec.series).isNotNull()).withColumn(spec.date, F.col(spec.date).cast("date"))
        self.panel = dated.checkpoint()
        featured = panel_features(self.panel, spec.series, spec.date, spec.target)
        numeric, categorical = feature_columns(
            featured, [spec.series, spec.date], spec.target, spec.exclude_leaky
        )
        self.features = FeatureSet(numeric, categorical)
        self.usable = usable_rows(featured, spec.target)

    def gate(self) -> DataFrame:
        """Which series have enough history, with their counts."""
        spec = self.spec
        return history_gate(self.usable, spec.series, spec.date, spec.min_train, spec.valid)

    def kept(self) -> DataFrame:
        """Usable rows of the series that pass the gate."""
        spec = self.spec
        passing = self.gate().filter("is_kept").select(spec.series)
        return self.usable.join(passing, spec.series, "left_semi")

    def folds(self) -> DataFrame:
        spec = self.spec
        return expanding_folds(self.usable, spec.series, spec.date, spec.min_train, spec.valid)

    def fold_matrix(self) -> DataFrame:
        """Preprocessed rows of every fold, parameters from its training rows."""
        spec, keys = self.spec, [self.spec.series, "fold"]
        folds = self.folds()
        parameters = fit_preprocessor(folds.filter(F.col("role") == "train"), keys, self.features)
        return apply_preprocessor(folds, parameters, keys, self.features, [spec.date, "role", spec.target])

    def cross_predictions(self) -> DataFrame:
        """Validation predictions of every candidate and fold.

        Families that fit from moments read sums over growing prefixes of each series; the
        others get the rows of every fold.
        """
        spec, parts = self.spec, []
        additive = [c for c in spec.candidates if families_of([c])[c.family].from_moments is not None]
        others = [c for c in spec.candidates if c not in additive]
        if additive:
            parts.append(
                cross_predict_expanding(
                    self.usable, spec.series, spec.date, spec.target, self.features, additive, spec.min_train, spec.valid
                )
            )
        if others:
            parts.append(cross_predict(self.fold_matrix(), spec.series, spec.date, spec.target, others))
        return stack_frames(parts)

    def results(self) -> DataFrame:
        """Mean fold metrics of every candidate and series."""
        keys = [self.spec.series, "model_name"]
        return mean_metrics(fold_metrics(self.cross_predictions(), keys), keys)

    def best(self, results: DataFrame | None = None) -> DataFrame:
        return best_models(results if results is not None else self.results(), self.spec.series, self.grid())

    def grid(self) -> list[str]:
        """Candidate labels in the order of the search."""
        return [c.label for c in self.spec.candidates]

    def parameters(self) -> DataFrame:
        return fit_preprocessor(self.kept(), [self.spec.series], self.features)

    def refit(self, candidates: Sequence[Candidate] | None = None, chosen: DataFrame | None = None) -> DataFrame:
        """Candidates fitted on all usable rows of every kept series, or the chosen ones of each."""
        spec = self.spec
        matrix = apply_preprocessor(
            self.kept(), self.parameters(), [spec.series], self.features, [spec.date, spec.target]
        )
        return fit_models(matrix, spec.series, spec.date, spec.target, candidates or spec.candidates, chosen)

    def forecast(self, chosen: DataFrame | None = None) -> DataFrame:
        """Monthly forecasts of the (series, model_name) pairs in ``chosen``.

        Without it every candidate is forecast for every kept series.
        """
        spec = self.spec
        # Kept, as a series' future rows and its recursion both read the models.
        models = keep_table(self.refit(chosen=None if chosen is None else chosen.select(spec.series, "model_name")))
        return recursive_forecast(
            self.panel,
            models,
            self.parameters(),
            self.features,
            spec.series,
            spec.date,
            spec.target,
            spec.horizon,
            spec.end,
        )

    def best_forecast(self, results: DataFrame | None = None) -> DataFrame:
        """Forecast of each series by its best model."""
        chosen = self.best(results).withColumnRenamed("best_model_name", "model_name")
        return self.forecast(chosen)

    def top_forecasts(self, results: DataFrame, k: int = 5) -> DataFrame:
        """True forecasts of the k best models per series, labelled by model."""
        order = [*METRICS, grid_place(F.col("model_name"), self.grid()), "model_name"]
        chosen = top_per_group(results, [self.spec.series], order, k)
        return self.forecast(chosen)

    def annual(self, forecast: DataFrame) -> DataFrame:
        return annual_forecast(forecast, [self.spec.series])

    def importance(self, chosen: DataFrame, repeats: int = 10) -> DataFrame:
        """Permutation importance of one chosen (series, model_name) per series."""
        spec, keys = self.spec, [self.spec.series, "model_name"]
        # One row per series; kept, as two steps read it.
        fitted = keep_table(self.refit(chosen=chosen.select(*keys)).drop("model_name", "converged"))
        fitted = fitted.join(self.parameters(), spec.series)

        def predict(rows: DataFrame) -> DataFrame:
            scored = rows.join(fitted, spec.series).withColumn("features", feature_vector(self.features))
            return scored.withColumn(
                "prediction", model_prediction(F.col("features"), linear_prediction(), F.col("trees"))
            )

        rows = self.kept().join(fitted.select(spec.series), spec.series, "left_semi")
        return permutation_importance(
            rows, predict, self.features.names, spec.series, spec.date, spec.target, repeats
        )

    def save(self, folder: str) -> None:
        """Write the candidate, best-model, monthly, annual and importance tables.

        The search and the forecast are each computed once and kept, since
        several of the tables are made from them.
        """
        spec = self.spec
        results = keep_table(self.results())
        best = keep_table(self.best(results))
        chosen = best.withColumnRenamed("best_model_name", "model_name")
        forecast = keep_table(self.forecast(chosen))
        monthly = forecast.select("date", spec.series, "prediction", "year", "month")
        importance = self.importance(chosen)
        write_csv(results.orderBy(spec.series, *METRICS), f"{folder}/model_results")
        write_csv(best.orderBy(spec.series), f"{folder}/best_models")
        write_csv(monthly.orderBy(spec.series, "date"), f"{folder}/monthly_forecast")
        write_csv(self.annual(forecast).orderBy(spec.series, "year"), f"{folder}/annual_forecast")
        write_per_series(
            importance.orderBy(spec.series, F.col("importance_mean").desc()),
            f"{folder}/feature_importance",
            spec.series,
        )
