"""Expanding folds without copies of rows: order statistics and sums over growing prefixes.

The months of a series are cut into blocks: the first training months, then each fold's
validation months. A fold trains on all blocks up to its own and validates on the next, so
whatever its training rows give is a prefix over blocks. Each series' rows, one per month,
are gathered once and stay one row; its folds are arrays in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.families import families_of
from tidemark.operators.folds import MIN_TRAIN_MONTHS, VALID_MONTHS
from tidemark.operators.linear import Candidate, Moments, spread_groups
from tidemark.operators.preprocess import EPSILON, FeatureSet
from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)


def block_rows(
    df: DataFrame,
    series: str,
    date: str,
    target: str,
    features: FeatureSet,
    min_train: int = MIN_TRAIN_MONTHS,
    valid: int = VALID_MONTHS,
) -> DataFrame:
    """One row per series with a fold: ``n_folds`` and the arrays ``blocks``, ``dates``, ``targets``,
    ``numbers`` and ``labels`` of its rows in the order of their dates.

    Rows after the last whole validation block take part in no fold and are left out.
    """
    window = Window.partitionBy(series)
    ranked = df.filter(F.col(date).isNotNull()).withColumn("_r", F.dense_rank().over(window.orderBy(date)))
    last = F.floor((F.max("_r").over(window) - min_train) / valid).cast("int")
    block = F.greatest(F.floor((F.col("_r") - min_train - 1) / valid).cast("int") + 1, F.lit(0))
    numbers = F.array(*[F.col(c).cast("double") for c in features.numeric]).cast("array<double>")
    labels = F.array(*[F.col(c).cast("string") for c in features.categorical]).cast("array<string>")
    placed = ranked.select(
        series, last.alias("n_folds"),
        F.struct(
            F.col(date).alias("date"), block.alias("block"), F.col(target).cast("double").alias("target"),
            numbers.alias("numbers"), labels.alias("labels"),
        ).alias("row"),
    ).filter((F.col("n_folds") >= 1) & (F.col("row.block") <= F.col("n_folds")))
    gathered = placed.groupBy(series, "n_folds").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    names = {"blocks": "block", "dates": "date", "targets": "target", "numbers": "numbers", "labels": "labels"}
    return gathered.select(series, "n_folds", *[F.col(f"rows.{n}").alias(c) for c, n in names.items()])


def _known(values: str, place: int) -> Column:
    """The known values of one column with their blocks, sorted by value."""
    pairs = F.zip_with(values, "blocks", lambda v, b: F.struct(F.get(v, F.lit(place)).alias("v"), b.alias("b")))
    return F.array_sort(F.filter(pairs, lambda p: p["v"].isNotNull()))


def _per_fold(pairs: Column, use) -> Column:
    """``use`` of the values known up to each fold's block; the sorted values are filtered, not sorted again."""
    folds = F.sequence(F.lit(0), F.col("n_folds") - 1)
    return F.transform(folds, lambda f: use(F.transform(F.filter(pairs, lambda p: p["b"] <= f), lambda p: p["v"])))


def _middle(values: Column) -> Column:
    low = F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))
    return 0.5 * low + 0.5 * F.get(values, F.floor(F.size(values) / 2).cast("int"))


def _most_frequent(values: Column) -> Column:
    counted = F.transform(
        F.array_distinct(values), lambda c: F.struct((-F.size(F.filter(values, lambda v: v == c))).alias("n"), c.alias("c"))
    )
    return F.get(F.array_sort(counted), F.lit(0))["c"]


def expanding_fills(blocks: DataFrame, features: FeatureSet) -> DataFrame:
    """``block_rows`` with the fills of every fold's training rows: ``medians[column][fold]``,
    ``modes[column][fold]`` and ``categories[column][fold]``.

    A column's values are sorted once for all folds. The results are those of ``fit_preprocessor``
    on each fold's training rows: exact medians, the least of the most frequent labels, the sorted
    list of labels; null or empty where a column has no value yet.
    """
    numeric, categorical = range(len(features.numeric)), range(len(features.categorical))
    medians = [_per_fold(_known("numbers", i), _middle) for i in numeric]
    modes = [_per_fold(_known("labels", i), _most_frequent) for i in categorical]
    lists = [_per_fold(_known("labels", i), lambda v: F.array_sort(F.array_distinct(v))) for i in categorical]
    return blocks.withColumns(
        {
            "medians": F.array(*medians).cast("array<array<double>>"),
            "modes": F.array(*modes).cast("array<array<string>>"),
            "categories": F.array(*lists).cast("array<array<array<string>>>"),
        }
    )


def fold_fills(filled: DataFrame, series: str) -> DataFrame:
    """One row per (series, fold) of the fills, arrays in the order of the features."""
    folds = filled.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)))
    names = ("medians", "modes", "categories")
    return folds.select(
        series, "fold", *[F.transform(c, lambda of: F.get(of, F.col("fold"))).alias(c) for c in names]
    )


class PrefixSums:
    """Sums of products over the first blocks, from which every fold's moments follow.

    Each row is laid out as a one, the numbers less a fixed shift and 0 where missing, marks of
    what is missing, marks of every label and of missing ones, and the target. A fold's imputed,
    scaled features are linear in that layout whatever the fold's fills are, so the products of
    features follow from the products of the layout, summed once.
    """

    def __init__(self, blocks, numbers: np.ndarray, labels: np.ndarray, targets: np.ndarray, folds: int) -> None:
        n, p = numbers.shape
        known = ~np.isnan(numbers)
        first = np.where(known.any(axis=0), known.argmax(axis=0), 0)
        # A column without change is 0 throughout, so its spread is 0 without rounding.
        self.shift = np.where(known.any(axis=0), numbers[first, np.arange(p)], 0.0) if n else np.zeros(p)
        moved = np.where(known, numbers - self.shift, 0.0)
        self.values = [sorted({v for v in labels[:, k] if v is not None}) for k in range(labels.shape[1])]
        marks = [labels[:, k] == v for k, own in enumerate(self.values) for v in own]
        gaps = [np.array([v is None for v in labels[:, k]]) for k in range(labels.shape[1])]
        self.level = targets.mean() if n else 0.0
        columns = [np.ones(n), *moved.T, *(~known).T, *marks, *gaps, targets - self.level]
        self.rows = np.stack([np.asarray(c, float) for c in columns], axis=1)
        own = np.stack([self.rows[blocks == b].T @ self.rows[blocks == b] for b in range(folds)])
        self.sums = np.cumsum(own, axis=0)
        self.places, at = {}, 1 + 2 * p
        for k, values in enumerate(self.values):
            for value in values:
                self.places[k, value], at = at, at + 1
        self.gaps = [at + k for k in range(len(self.values))]

    def layout(self, fold: int, medians, modes, categories) -> tuple[np.ndarray, Moments]:
        """The map from rows to a fold's features, and the moments of its training rows."""
        sums, p = self.sums[fold], len(self.shift)
        n = sums[0, 0]
        wide = p + sum(map(len, categories))
        to = np.zeros((len(sums), wide))
        for j in range(p):
            if medians[j] is None or np.isnan(medians[j]):
                continue
            value, gap, fill = 1 + j, 1 + p + j, medians[j] - self.shift[j]
            mean = (sums[0, value] + fill * sums[0, gap]) / n
            # The mean square around the mean, of known and of filled values.
            square = sums[value, value] - 2 * mean * sums[0, value] + mean * mean * (n - sums[0, gap])
            variance = max((square + sums[0, gap] * (fill - mean) ** 2) / n, 0.0)
            noise = n * EPSILON * variance + (n * EPSILON * (mean + self.shift[j])) ** 2
            scale = 1.0 if variance <= noise else np.sqrt(variance)
            to[0, j], to[value, j], to[gap, j] = -mean / scale, 1 / scale, fill / scale
        at = p
        for k, own in enumerate(categories):
            for value in own:
                to[self.places[k, value], at] = 1.0
                if value == modes[k]:
                    to[self.gaps[k], at] = 1.0
                at += 1
        centre = to.T @ sums[0] / n
        shifted = to.copy()
        shifted[0] -= centre
        y = len(sums) - 1
        mean = sums[0, y] / n
        moment = shifted.T @ sums[:, y] - (shifted.T @ sums[:, 0]) * mean
        energy = sums[y, y] - n * mean * mean
        return to, Moments(int(n), centre, shifted.T @ sums @ shifted, moment, mean + self.level, float(energy))


def cross_predict_expanding(
    df: DataFrame,
    series: str,
    date: str,
    target: str,
    features: FeatureSet,
    candidates: Sequence[Candidate],
    min_train: int = MIN_TRAIN_MONTHS,
    valid: int = VALID_MONTHS,
) -> DataFrame:
    """Validation predictions of every candidate and fold, for families that fit from moments:
    (series, fold, date, model_name, actual, prediction).

    The same as ``cross_predict`` on the copied rows of ``expanding_folds``, but each row is
    gathered and summed once, whatever the number of folds.
    """
    families = families_of(candidates)
    names = [series, "fold", date, "model_name", "actual", "prediction"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield one(row)

    def one(row) -> pd.DataFrame:
        blocks, dates, targets = (np.array(v) for v in (row.blocks, row.dates, row.targets))
        numbers = np.stack([np.asarray(v, float) for v in row.numbers])
        labels = np.array([list(v) for v in row.labels], object).reshape(len(blocks), -1)
        sums = PrefixSums(blocks, numbers, labels, targets.astype(float), row.n_folds)
        out = []
        for fold in range(row.n_folds):
            own = [[c[fold] for c in of] for of in (row.medians, row.modes, row.categories)]
            to, moments = sums.layout(fold, *own)
            chosen = np.flatnonzero(blocks == fold + 1)
            x = sums.rows[chosen] @ to
            for name, family in families.items():
                mine = [c for c in candidates if c.family == name]
                for candidate, model in zip(mine, family.from_moments(moments, mine)):
                    values = model.intercept + x @ model.weights
                    out += [
                        (row[0], fold, dates[i], candidate.label, float(targets[i]), float(v))
                        for i, v in zip(chosen, values)
                    ]
        return pd.DataFrame(out, columns=names)

    types = dict(df.dtypes)
    schema = (
        f"`{series}` {types[series]}, fold int, `{date}` {types[date]}, "
        "model_name string, actual double, prediction double"
    )
    blocks = block_rows(df, series, date, target, features, min_train, valid)
    return spread_groups(expanding_fills(blocks, features), series).mapInPandas(run, schema)
