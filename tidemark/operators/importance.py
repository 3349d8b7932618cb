"""Permutation importance: how much R squared drops when a feature is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.permute import permuted_rank


def permutation_importance(
    rows: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    series: str,
    date: str,
    target: str,
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Mean and population deviation of the R squared drop per (series, feature).

    ``predict`` adds a ``prediction`` column to rows that have the feature columns. Each
    feature is shuffled ``repeats`` times within its series: a row's value goes to the row
    at the place that a keyed permutation gives its rank, a join on (series, place). A value
    travels alone, so the rows themselves are moved once, and no series is held in one
    place, however long. The key names seed, feature and repeat, so reruns agree.
    """
    features = list(features)
    # Rows of one date are told apart by a digest of their values.
    order = Window.partitionBy(series).orderBy(date, F.xxhash64(target, *features))
    sizes = rows.groupBy(F.col(series).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = (
        rows.select(
            series, F.col(target).cast("double").alias("_y"), *[F.col(c) for c in features],
            (F.row_number().over(order) - 1).cast("long").alias("_i"),
        )
        .join(sizes, F.col(series) == F.col("_of"))
        .drop("_of")
    )

    def is_number(c: str) -> bool:
        return isinstance(rows.schema[c].dataType, (T.NumericType, T.BooleanType))

    def value(c: str) -> Column:
        number = F.col(c).cast("double") if is_number(c) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_number(c) else F.col(c).cast("string")
        return F.struct(number.alias("number"), text.alias("text"))

    values = F.array(*[F.struct(F.lit(k).alias("f"), value(c).alias("v")) for k, c in enumerate(features)])
    single = ranked.select(series, "_i", "_n", F.explode(values).alias("_one")).select(
        series, "_i", "_n", "_one.f", "_one.v", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")
    )
    key = F.concat_ws("|", F.lit(str(seed)), F.col("f").cast("string"), F.col("_r").cast("string"))
    sent = single.select(
        F.col(series).alias("_to"), permuted_rank(F.col("_i"), F.col("_n"), key).alias("_at"),
        F.col("f").alias("_f"), "_r", F.col("v").alias("_v"),
    )
    met = ranked.join(sent, (F.col(series) == F.col("_to")) & (F.col("_i") == F.col("_at")))

    def mixed(k: int, c: str) -> Column:
        kind = rows.schema[c].dataType
        given = F.col("_v.number").cast(kind) if is_number(c) else F.col("_v.text").cast(kind)
        return F.when(F.col("_f") == k, given).otherwise(F.col(c)).alias(c)

    copies = met.select(series, "_f", "_r", "_y", *[mixed(k, c) for k, c in enumerate(features)])
    # Copy -1 is the unshuffled table, scored along with the others.
    plain = ranked.select(series, F.lit(-1).alias("_f"), F.lit(0).alias("_r"), "_y", *features)
    scored = predict(copies.union(plain))

    error = F.col("_y") - F.col("prediction")
    fits = scored.groupBy(series, "_f", "_r").agg(
        F.sum(error * error).alias("_sse"), (F.var_pop("_y") * F.count("_y")).alias("_sst")
    )
    score = 1 - F.try_divide(F.col("_sse"), F.col("_sst"))
    # A series has one score per feature and repeat, so its window is small.
    base = F.max(F.when(F.col("_f") < 0, score)).over(Window.partitionBy(series))
    scores = fits.select(series, "_f", (base - score).alias("_drop"))
    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_f") + 1)
    return (
        scores.filter(F.col("_f") >= 0)
        .groupBy(series, named.alias("feature"))
        .agg(F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std"))
    )
