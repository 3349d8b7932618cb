"""Expanding-window folds over each series' distinct months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_TRAIN_MONTHS = 24
VALID_MONTHS = 3


def expanding_folds(
    df: DataFrame, series: str, date: str, min_train: int = MIN_TRAIN_MONTHS, valid: int = VALID_MONTHS
) -> DataFrame:
    """Repeat each row once per fold it takes part in, with its role.

    Fold f trains on the first ``min_train + valid * f`` distinct months and
    validates on the next ``valid`` ones. A row validates in one fold and
    trains in all later ones, so its folds are a range worked out from its
    month rank: no join with a fold table.
    """
    window = Window.partitionBy(series)
    ranked = df.filter(F.col(date).isNotNull()).withColumn("_r", F.dense_rank().over(window.orderBy(date)))
    sized = ranked.withColumn("_n", F.max("_r").over(window))
    last = F.floor((F.col("_n") - min_train) / valid).cast("int") - 1
    own = F.floor((F.col("_r") - min_train - 1) / valid).cast("int")
    first = F.greatest(own, F.lit(0))
    placed = sized.withColumn("_own", own).filter((last >= 0) & (first <= last))
    folds = placed.withColumn("fold", F.explode(F.sequence(first, last)))
    role = F.when(F.col("fold") == F.col("_own"), F.lit("valid")).otherwise(F.lit("train"))
    return folds.withColumn("role", role).drop("_r", "_n", "_own")


def history_gate(
    usable: DataFrame, series: str, date: str, min_train: int = MIN_TRAIN_MONTHS, valid: int = VALID_MONTHS
) -> DataFrame:
    """Usable row and month counts per series and whether they allow a fold."""
    counts = usable.groupBy(series).agg(
        F.count(F.lit(1)).alias("usable_rows"), F.count_distinct(date).alias("usable_months")
    )
    enough = (F.col("usable_rows") >= min_train + valid) & (F.col("usable_months") >= min_train + valid)
    return counts.withColumn("is_kept", enough)
