"""Best and top-k rows per group, and forecast error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip_at_zero

METRICS = ("rmse_mean", "mae_mean", "mape_mean")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows of each group. Spark prunes to k rows per group and task
    before the shuffle (window group limit), so hot groups stay small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest order columns per group (nulls last), as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_best"))
    return best.select(*keys, "_best.*").select(df.columns)


def last_row(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Latest row of every series."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(date)).alias("_last"))
    return last.select(*keys, "_last.*").select(df.columns)


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def mape(error: Column, actual: Column, epsilon: float = 1e-6) -> Column:
    return F.avg(F.abs(error / F.greatest(F.abs(actual), F.lit(epsilon)))) * 100


def fold_metrics(
    scored: DataFrame, keys: Sequence[str], actual: str = "actual", prediction: str = "prediction", fold: str = "fold"
) -> DataFrame:
    """RMSE, MAE and MAPE per fold; predictions below zero count as zero."""
    error = F.col(actual) - clip_at_zero(F.col(prediction))
    return scored.groupBy(*keys, fold).agg(
        rmse(error).alias("rmse"), mae(error).alias("mae"), mape(error, F.col(actual)).alias("mape")
    )


def mean_metrics(per_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the fold metrics per candidate."""
    return per_fold.groupBy(*keys).agg(
        F.avg("rmse").alias("rmse_mean"), F.avg("mae").alias("mae_mean"), F.avg("mape").alias("mape_mean")
    )


def grid_place(name: Column, grid: Sequence[str]) -> Column:
    """Position of a candidate in the search grid; candidates outside come last."""
    place = F.array_position(F.array(*[F.lit(g) for g in grid]).cast("array<string>"), name)
    return F.when(place > 0, place).otherwise(len(grid) + 1)


def best_models(results: DataFrame, series: str, grid: Sequence[str] = ()) -> DataFrame:
    """Winning candidate per series: smallest RMSE, then MAE, then MAPE, then the first in the grid."""
    placed = results.withColumn("_grid", grid_place(F.col("model_name"), grid))
    best = best_per_group(placed, [series], [*METRICS, "_grid", "model_name"])
    return best.select(
        series,
        F.col("model_name").alias("best_model_name"),
        F.col("rmse_mean").alias("best_rmse"),
        F.col("mae_mean").alias("best_mae"),
        F.col("mape_mean").alias("best_mape"),
    )
