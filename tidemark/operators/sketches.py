"""Stored sketches: quantiles and distinct counts of any range of months without the facts.

One scan of the facts leaves a row per (series, month) with a quantile sketch, a distinct
sketch and plain sums, all mergeable. Any later range merges those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.operators.rollup import drop_null_keys

#: Items that a quantile sketch keeps of its finest level. Fewer values than that are kept as
#: they are; of more, a quantile's rank is off by about ``2.3 / k**0.9``, 0.13 % here.
QUANTILE_K = 4096
#: Bits of a distinct sketch: a count is off by 1.04 / 2**(bits / 2), 0.4 % here; up to some thousands are exact.
DISTINCT_BITS = 16


def month_sketches(
    df: DataFrame, keys: Sequence[str], date: str, value: str, distinct: str, k: int = QUANTILE_K
) -> DataFrame:
    """One row per (keys, month): ``value_sketch``, ``distinct_sketch``, ``n``, ``total``, ``least`` and ``most``.

    Null keys and dates are left out; null values count in neither sketch.
    """
    rows = drop_null_keys(df, keys).filter(F.col(date).isNotNull()).withColumn("month", month_start(F.col(date)))
    number = F.col(value).cast("double")
    return rows.groupBy(*keys, "month").agg(
        F.kll_sketch_agg_double(number, F.lit(k)).alias("value_sketch"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), DISTINCT_BITS).alias("distinct_sketch"),
        F.count(number).alias("n"),
        F.sum(number).alias("total"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
    )


def merged_sketches(
    sketches: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], k: int = QUANTILE_K
) -> DataFrame:
    """Per ``keys``: the merged ``n``, ``total``, ``least``, ``most``, ``distinct`` and named quantiles.

    A quantile is a value of the table: the least one whose rank reaches the given share.
    """
    merged = sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("value_sketch", F.lit(k)).alias("_values"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        *[F.sum(c).alias(c) for c in ("n", "total")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )
    points = {
        name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_values", F.lit(float(p))))
        for name, p in quantiles.items()
    }
    return merged.withColumns(points).drop("_values")
