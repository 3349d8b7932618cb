"""Future rows, recursive multi-month forecasts and annual totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import earliest, month_sequence, next_month_start
from tidemark.operators.features import LAGS, ROLL_WINDOWS, calendar_features
from tidemark.operators.families import model_prediction
from tidemark.operators.linear import linear_prediction
from tidemark.operators.preprocess import FeatureSet, feature_vector
from tidemark.operators.selection import last_row

HORIZON_MONTHS = 12
# Event flags that are off in the future.
FUTURE_ZEROS = ("covid_flag",)


def future_stub(
    panel: DataFrame,
    series: str,
    date: str,
    target: str,
    horizon: int = HORIZON_MONTHS,
    end: str | None = None,
    zeros: Sequence[str] = FUTURE_ZEROS,
) -> DataFrame:
    """Copy each series' last row to the next ``horizon`` months.

    Date, year and month move on, the target is null and the listed flags are
    zero. Months after ``end`` are left out.
    """
    last = last_row(panel.filter(F.col(series).isNotNull()), [series], date)
    start = next_month_start(F.col(date))
    stop = F.add_months(start, horizon - 1)
    if end is not None:
        stop = earliest([stop, F.lit(end).cast("date")])
    stub = last.withColumn("_date", F.explode(month_sequence(start, stop)))
    moved: dict[str, Column] = {date: F.col("_date"), target: F.lit(None).cast(panel.schema[target].dataType)}
    for name, part in (("year", F.year), ("month", F.month)):
        if name in panel.columns:
            moved[name] = part("_date").cast(panel.schema[name].dataType)
    for name in zeros:
        if name in panel.columns:
            moved[name] = F.lit(0).cast(panel.schema[name].dataType)
    return stub.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in panel.columns])


def recent_history(panel: DataFrame, series: str, date: str, target: str, size: int) -> DataFrame:
    """Last ``size`` targets per series (newest last, nulls kept) and the last
    known one. Only ``size`` values per series leave a task."""
    window = Window.partitionBy(series).orderBy(F.col(date).desc())
    value = F.col(target).cast("double")
    ranked = panel.filter(F.col(series).isNotNull()).select(
        series,
        date,
        value.alias("_y"),
        F.row_number().over(window).alias("_rn"),
    )
    tail = ranked.filter(F.col("_rn") <= size).groupBy(series).agg(
        F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col("_y").alias("y")))).alias("_rows")
    )
    known = (
        panel.filter(F.col(series).isNotNull() & F.col(target).isNotNull())
        .groupBy(series)
        .agg(F.max_by(value, F.col(date)).alias("last_known"))
    )
    history = F.transform("_rows", lambda r: r["y"]).alias("history")
    return tail.join(known, series, "left").select(series, history, "last_known")


def lag_values(history: Column, target: str, lags: Sequence[int], windows: Sequence[int]) -> dict[str, Column]:
    """Lag and rolling features of the next row, read off a history array."""

    def back(k: int) -> Column:
        return F.get(history, F.size(history) - k)

    def mean(w: int) -> Column:
        recent = F.slice(history, F.greatest(F.size(history) - w + 1, F.lit(1)), w)
        total = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(history) >= w, total / w)

    values = {f"{target}_lag_{k}": back(k) for k in lags}
    values |= {f"{target}_roll_mean_{w}": mean(w) for w in windows}
    return values


def fold_forecast(
    plans: DataFrame,
    keys: Sequence[str],
    target: str,
    lag_terms: Mapping[str, tuple[Column, Column]],
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = ROLL_WINDOWS,
    tree_slots: Mapping[str, tuple[int, Column, Column]] | None = None,
) -> DataFrame:
    """Run the recursion natively, one row per (series, model).

    ``plans`` holds ``steps`` (array of (date, base)), ``history`` and
    ``last_known``. A step's prediction is its base plus weight * (value - fill)
    for each known lag feature; ``lag_terms`` gives (weight, fill). It is clipped
    at zero and appended to the history. When every lag is unknown the last known
    value is carried, and with none the month is left out.

    With ``tree_slots``, the place, mean and scale of lag features, ``plans`` also has
    ``trees`` and each step ``features``, and the prediction adds the values that the
    features reach in the trees, known lags put in their places.
    """
    slots = tree_slots or {}

    def filled(item: Column, values: Mapping[str, Column]) -> Column:
        def slot(x: Column, i: Column) -> Column:
            chosen = x
            for name, (place, mean, scale) in slots.items():
                chosen = F.when(i == place, F.coalesce((values[name] - mean) / scale, x)).otherwise(chosen)
            return chosen

        return F.transform(item["features"], slot)

    def step(state: Column, item: Column) -> Column:
        values = lag_values(state["history"], target, lags, windows)
        total = item["base"]
        for name, (weight, fill) in lag_terms.items():
            total = total + F.coalesce(weight * (values[name] - fill), F.lit(0.0))
        if tree_slots is not None:
            grown = F.transform(
                F.array(filled(item, values)), lambda x: model_prediction(x, F.lit(0.0), F.col("trees"))
            )
            total = total + F.get(grown, F.lit(0))
        any_known = F.coalesce(*values.values()).isNotNull()
        clipped = F.greatest(total, F.lit(0.0))
        prediction = F.when(any_known, clipped).otherwise(state["last_known"])
        return F.struct(
            F.concat(state["history"], F.array(prediction)).alias("history"),
            F.coalesce(prediction, state["last_known"]).alias("last_known"),
            F.concat(
                state["out"], F.array(F.struct(item["date"].alias("date"), prediction.alias("prediction")))
            ).alias("out"),
        )

    start = F.struct(
        F.col("history"),
        F.col("last_known"),
        F.array().cast("array<struct<date:date,prediction:double>>").alias("out"),
    )
    done = F.aggregate("steps", start, step, lambda state: state["out"])
    rows = plans.select(*keys, F.explode(done).alias("_f"))
    return rows.select(*keys, "_f.date", "_f.prediction").filter(F.col("prediction").isNotNull())


def recursive_forecast(
    panel: DataFrame,
    models: DataFrame,
    parameters: DataFrame,
    features: FeatureSet,
    series: str,
    date: str,
    target: str,
    horizon: int = HORIZON_MONTHS,
    end: str | None = None,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = ROLL_WINDOWS,
) -> DataFrame:
    """Forecast each (series, model) month by month, feeding predictions back.

    ``models`` has intercept, weights and trees per (series, model_name), ``parameters``
    the preprocessor row per series. The part of a prediction that does not
    depend on the lags is worked out per future row; the recursion runs over
    arrays of at most ``horizon`` items inside one expression, trees included.
    """
    names = list(lag_values(F.array().cast("array<double>"), target, lags, windows))
    position = {c: i for i, c in enumerate(features.numeric)}
    stub = calendar_features(future_stub(panel, series, date, target, horizon, end), date)
    # The seasonal difference needs the unknown target, so its median stands in.
    unknown = [c for c in (*names, f"{target}_seasonal_diff") if c in position]
    stub = stub.withColumns({c: F.lit(None).cast("double") for c in unknown})

    # With every lag unknown a prediction rests on the lags' medians; a step adds
    # what a known lag changes.
    keys = [series, "model_name"]
    ready = stub.join(parameters, series).join(models.select(*keys, "intercept", "weights"), series)
    scored = ready.withColumn("features", feature_vector(features)).withColumn("_base", linear_prediction())
    lagged = [c for c in names if c in position]
    terms = [F.expr(f"struct(weights[{i}] / scales[{i}], medians[{i}])") for i in map(position.get, lagged)]
    spreads = [F.expr(f"struct(means[{i}] AS col1, scales[{i}] AS col2)") for i in map(position.get, lagged)]
    steps = F.array_sort(
        F.collect_list(F.struct(F.col(date).alias("date"), F.col("_base").alias("base"), F.col("features")))
    )
    plans = scored.groupBy(*keys).agg(
        steps.alias("steps"),
        *[F.first(t).alias(f"_t{i}") for i, t in enumerate(terms)],
        *[F.first(t).alias(f"_s{i}") for i, t in enumerate(spreads)],
    )
    # The trees join the one row of a model, not its steps.
    plans = plans.join(models.select(*keys, "trees"), keys)
    history = recent_history(panel, series, date, target, max(*lags, *windows))
    lag_terms = {c: (F.col(f"_t{i}.col1"), F.col(f"_t{i}.col2")) for i, c in enumerate(lagged)}
    slots = {c: (position[c], F.col(f"_s{i}.col1"), F.col(f"_s{i}.col2")) for i, c in enumerate(lagged)}
    out = fold_forecast(plans.join(history, series), keys, target, lag_terms, lags, windows, slots)
    return with_year_month(out)


def with_year_month(forecast: DataFrame, date: str = "date") -> DataFrame:
    return forecast.withColumn("year", F.year(date)).withColumn("month", F.month(date))


def annual_forecast(
    forecast: DataFrame, keys: Sequence[str], prediction: str = "prediction", name: str = "forecast_students"
) -> DataFrame:
    """Sum of the monthly predictions per (keys, year)."""
    return forecast.groupBy(*keys, "year").agg(F.sum(prediction).alias(name))
