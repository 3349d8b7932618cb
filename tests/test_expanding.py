"""Folds as prefixes against folds as copied rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.expanding import block_rows, cross_predict_expanding, expanding_fills, fold_fills
from tidemark.operators.families import cross_predict
from tidemark.operators.folds import expanding_folds
from tidemark.operators.linear import LINEAR_CANDIDATES, Candidate
from tidemark.operators.preprocess import FeatureSet, apply_preprocessor, fit_preprocessor

FEATURES = FeatureSet(["a", "b", "late", "flat", "none", "big"], ["c", "seldom"])
SCHEMA = "s string, d date, y double, a double, b double, late double, flat double, none double, big double, c string, seldom string"


@pytest.fixture(scope="module")
def usable(spark):
    draw = random.Random(5)
    rows = []
    for s, n in (("long", 70), ("odd", 41), ("brief", 27), ("short", 26)):
        for i in range(n):
            day = dt.date(2012 + i // 12, i % 12 + 1, 1)
            value = lambda share, scale=1.0: None if draw.random() < share else draw.gauss(0, 1) * scale
            label = draw.choice(["x", "y", None]) if i < 30 else draw.choice(["w", "x", "z"])
            seldom = "once" if i == 33 else None
            row = (draw.gauss(i, 20), value(0.2), value(0.1, 3), value(0.3) if i > 25 else None, 4.25, None, 2000.5 + i / 12)
            rows.append((s, day, *row, label, seldom))
            if s == "odd" and i % 9 == 0:
                rows.append((s, day, row[0] + 0.5, *row[1:-1], None, label, None))
    return spark.createDataFrame(rows, SCHEMA)


def learned(usable):
    folds = expanding_folds(usable, "s", "d", 24, 3)
    return folds, fit_preprocessor(folds.filter("role = 'train'"), ["s", "fold"], FEATURES)


def test_fills_equal_those_of_each_fold(usable):
    _, parameters = learned(usable)
    want = {(r.s, r.fold): r for r in parameters.collect()}
    got = fold_fills(expanding_fills(block_rows(usable, "s", "d", "y", FEATURES), FEATURES), "s").collect()
    assert {(r.s, r.fold) for r in got} == set(want) and {r.s for r in got} == {"long", "odd", "brief"}
    for r in got:
        of = want[r.s, r.fold]
        assert r.medians == pytest.approx(of.medians, abs=1e-12, nan_ok=True) or [
            (a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(r.medians, of.medians)
        ] == [True] * len(r.medians)
        assert (r.modes, r.categories) == (of.modes, of.categories)


def test_predictions_equal_those_on_copied_rows(usable):
    folds, parameters = learned(usable)
    matrix = apply_preprocessor(folds, parameters, ["s", "fold"], FEATURES, ["d", "role", "y"])
    tight = [c for c in LINEAR_CANDIDATES if c.family == "ridge"] + [Candidate("elasticnet", (("alpha", 0.5), ("l1_ratio", 0.5)))]
    key = lambda r: (r.s, r.fold, r.d, r.model_name, r.actual)
    want = {key(r): r.prediction for r in cross_predict(matrix, "s", "d", "y", tight).collect()}
    got = {key(r): r.prediction for r in cross_predict_expanding(usable, "s", "d", "y", FEATURES, tight).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_no_row_is_copied_per_fold(usable):
    plan = cross_predict_expanding(usable, "s", "d", "y", FEATURES, LINEAR_CANDIDATES)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


def test_empty_and_too_short(usable):
    none = usable.filter("s = 'short'")
    assert cross_predict_expanding(none, "s", "d", "y", FEATURES, LINEAR_CANDIDATES).count() == 0
    assert cross_predict_expanding(none.limit(0), "s", "d", "y", FEATURES, LINEAR_CANDIDATES).count() == 0
    assert block_rows(usable.withColumn("d", F.lit(None).cast("date")), "s", "d", "y", FEATURES).count() == 0

