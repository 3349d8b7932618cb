"""Exact group quantiles and the trimmed mean, without holding a group in a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import interpolate, round_half_even
from tidemark.operators.joins import join_group_values
from tidemark.operators.rollup import drop_null_keys


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    accuracy: int = 100_000,
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size.

    Spark's exact ``percentile`` keeps a value table per group in one task. Here
    a mergeable sketch first brackets each wanted rank; rows below the bracket
    are only counted, rows above it are dropped before any shuffle, and equal
    values inside it are counted map-side. Only a group's narrow bracket is
    ordered: 0.02 % of a large group around each quantile, 2 % of a middling
    one, all of one up to a thousand rows. A rank outside its bracket would fail
    the job, never change a result.
    """
    keys = list(keys)
    rows = drop_null_keys(df, keys).filter(F.col(value).isNotNull())
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"))

    probs = list(quantiles.values())
    # The sketch is off by at most 1/accuracy of a group's rows, a tenth of the
    # narrow margin; each margin spans at least ten rows of the groups using it.
    wide, narrow = 0.01, 10.0 / accuracy
    margins = [-wide, -narrow, narrow, wide]
    marks = [min(1.0, max(0.0, p + m)) for p in probs for m in margins]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, accuracy).alias("_marks"),
    )
    is_tiny, is_large = F.col("_n") <= 10 / wide, F.col("_n") > 10 / narrow

    def mark(i: int, extreme: str, outer: int, inner: int):
        held = F.when(is_tiny, F.col(extreme)).when(is_large, F.col("_marks")[i * 4 + inner])
        return held.otherwise(F.col("_marks")[i * 4 + outer])

    entries = [
        F.struct(
            F.lit(i).alias("q"),
            (F.lit(p) * (F.col("_n") - 1)).alias("rank"),
            mark(i, "_min", 0, 1).alias("lo"),
            mark(i, "_max", 3, 2).alias("hi"),
        )
        for i, p in enumerate(probs)
    ]
    brackets = sketch.select(*keys, F.col("_n"), F.explode(F.array(*entries)).alias("_b")).select(*keys, "_n", "_b.*")

    near = join_group_values(rows, brackets, keys).filter(F.col("_v") <= F.col("hi"))
    by_value = [*keys, "q", "rank", "_n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")]
    counted = near.groupBy(*by_value).agg(F.count(F.lit(1)).alias("_c"))

    order = Window.partitionBy(*keys, "q").orderBy(F.col("_v").asc_nulls_first())
    running = counted.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.floor("rank")
    second = F.least(first + 1, F.col("_n") - 1)

    def at(rank):
        held = (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
        return F.max(F.when(held, F.col("_v")))

    picked = running.groupBy(*keys, "q").agg(
        at(first).alias("_lower"), at(second).alias("_upper"), F.first(F.col("rank") - first).alias("_part")
    )
    point = interpolate(F.col("_lower"), F.col("_upper"), F.col("_part"))
    checked = F.when(point.isNotNull(), point).otherwise(
        F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")
    )
    named = [F.max(F.when(F.col("q") == i, F.col("_point"))).alias(n) for i, n in enumerate(quantiles)]
    return picked.withColumn("_point", checked).groupBy(*keys).agg(*named)


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median (midpoint of the two middle values) per group."""
    return group_quantiles(df, keys, value, {name: 0.5})


def keep_within(df: DataFrame, bounds: DataFrame, key: str, value: str, low: str, high: str) -> DataFrame:
    """Rows whose value lies in the closed bounds of their group."""
    joined = join_group_values(df, bounds.select(key, low, high), [key], "left")
    return joined.filter(F.col(value).between(F.col(low), F.col(high)))


def trimmed_mean(
    df: DataFrame,
    group: str,
    value: str,
    by: Sequence[str],
    low: float = 0.05,
    high: float = 0.95,
    name: str | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Mean by ``by`` over rows inside their group's quantile bounds."""
    rows = drop_null_keys(df, list(dict.fromkeys([value, group, *by])))
    bounds = group_quantiles(rows, [group], value, {"_q_low": low, "_q_high": high})
    kept = keep_within(rows, bounds, group, value, "_q_low", "_q_high")
    mean = F.avg(value)
    if digits is not None:
        mean = round_half_even(mean, digits)
    return kept.groupBy(*by).agg(mean.alias(name or f"mean_{value}"))
