"""Median/mode imputation, standardising and one-hot encoding per group.

Parameters are learned by one aggregation over training rows and joined back,
so every (series, fold) gets its own without a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class FeatureSet:
    """Feature names in matrix order; categorical ones expand to one-hot slots."""

    numeric: Sequence[str]
    categorical: Sequence[str] = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def fit_preprocessor(train: DataFrame, keys: Sequence[str], features: FeatureSet) -> DataFrame:
    """One row per key: medians, means and scales of the imputed columns, modes
    and category lists.

    Mean and deviation after imputation follow from those before it and the
    number of filled values, so one pass is enough. Groups are training rows of
    one panel series, at most as many as there are months, which also bounds
    the exact medians and the category lists.
    """
    counts = _each("double(count({0}))", features.numeric)
    medians = _each("median(double({0}))", features.numeric)
    means = _each("avg(double({0}))", features.numeric)
    variances = _each("var_pop(double({0}))", features.numeric)
    modes = _each("mode(string({0}), true)", features.categorical)
    categories = _each("array_sort(collect_set(string({0})))", features.categorical)
    learned = train.groupBy(*keys).agg(
        F.expr("double(count(1))").alias("total"),
        F.expr(f"cast({counts} as array<double>)").alias("counts"),
        F.expr(f"cast({medians} as array<double>)").alias("medians"),
        F.expr(f"cast({means} as array<double>)").alias("means"),
        F.expr(f"cast({variances} as array<double>)").alias("variances"),
        F.expr(f"cast({modes} as array<string>)").alias("modes"),
        F.expr(f"cast({categories} as array<array<string>>)").alias("categories"),
    )
    full_mean = "transform(counts, (k, i) -> (k * means[i] + (total - k) * medians[i]) / total)"
    full_variance = (
        "transform(counts, (k, i) -> (k * variances[i]"
        " + k * (total - k) / total * pow(means[i] - medians[i], 2)) / total)"
    )
    # A constant column keeps its scale: rounding noise is not a spread.
    scale = (
        f"transform({full_variance}, (v, i) -> if(v <= total * {EPSILON} * v"
        f" + pow(total * {EPSILON} * means[i], 2), 1D, sqrt(v)))"
    )
    return learned.select(
        *keys,
        "medians",
        F.expr(full_mean).alias("means"),
        F.expr(scale).alias("scales"),
        "modes",
        "categories",
    )


def _each(template: str, columns: Sequence[str]) -> str:
    """SQL array with the template filled in for every column."""
    return "array(" + ", ".join(template.format(f"`{c}`") for c in columns) + ")"


def feature_vector(features: FeatureSet) -> Column:
    """Array of imputed, scaled numeric features, then the one-hot slots.

    A column that was all null in training is 0; a category not seen in
    training has all its slots 0.
    """
    values = f"cast({_each('double({0})', features.numeric)} as array<double>)"
    labels = f"cast({_each('string({0})', features.categorical)} as array<string>)"
    numeric = (
        f"transform({values}, (x, i) -> coalesce((coalesce(x, medians[i]) - means[i]) / scales[i], 0D))"
    )
    slots = (
        f"flatten(transform({labels}, (x, i) -> "
        "transform(categories[i], c -> if(c = coalesce(x, modes[i]), 1D, 0D))))"
    )
    return F.expr(f"concat({numeric}, {slots})")


def apply_preprocessor(
    rows: DataFrame, parameters: DataFrame, keys: Sequence[str], features: FeatureSet, keep: Sequence[str]
) -> DataFrame:
    """Keys, kept columns and the ``features`` array of every row."""
    joined = rows.join(parameters, list(keys))
    return joined.select(*keys, *keep, feature_vector(features).alias("features"))
