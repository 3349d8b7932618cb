"""Histograms and density curves per group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_group_values

# A Gaussian kernel is exactly 0.0 in double precision beyond this many
# bandwidths, so skipping such grid points changes no result.
KERNEL_REACH = 39.0


def histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between each group's own minimum and maximum.

    The last bin is closed. A group with a single value has one bin. Empty bins
    give no row.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_v")).na.drop()
    ranges = rows.groupBy(group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    cell = F.floor((F.col("_v") - F.col("_lo")) / width * bins) + 1
    number = F.when(width == 0, F.lit(1)).otherwise(F.least(cell, F.lit(bins)))
    counted = join_group_values(rows, ranges, [group]).groupBy(group, number.cast("int").alias("bin"), "_lo", "_hi")
    step = F.when(width == 0, F.lit(1.0)).otherwise(width / bins)
    return counted.agg(F.count(F.lit(1)).alias("count")).select(
        group,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * step).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * step).alias("bin_end"),
        "count",
    )


def density(df: DataFrame, group: str, value: str, points: int = 200) -> DataFrame:
    """Gaussian density curve per group on an even grid over the group's range.

    Bandwidth is n^(-1/5) times the sample deviation. Equal values are counted
    first, each then adds to the grid points within reach of its kernel, and
    the sums are partial before the shuffle, so nothing group-sized moves.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_v")).na.drop()
    counted = rows.groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    weighed = join_group_values(counted, _curve_grid(rows, group, points), [group])
    return _kernel_sums(weighed, group, points, KERNEL_REACH)


def binned_density(
    df: DataFrame, group: str, value: str, points: int = 200, tolerance: float = 1e-6
) -> DataFrame:
    """``density`` from counts on a fine grid, at a cost that does not grow with the values.

    Each row adds to the two cells around it, in proportion to its nearness; these counts
    are sums, so they are partial before the shuffle and can be kept and merged. The
    kernel is then summed over cells. Cells are so fine, ``sqrt(8 * tolerance)`` bandwidths
    at most, that linear interpolation of the kernel is off by less than ``tolerance``
    times its peak; the kernel is cut off where less than a hundredth of that is left.
    The curve is nowhere off by more than 1.01 ``tolerance`` times ``1 / (h sqrt(2 pi))``.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_v")).na.drop()
    grid = _curve_grid(rows, group, points)
    cells = F.ceil((F.col("_hi") - F.col("_lo")) / (F.col("_h") * math.sqrt(8 * tolerance)))
    grid = grid.withColumn("_cell", (F.col("_hi") - F.col("_lo")) / cells)
    place = (F.col("_v") - F.col("_lo")) / F.col("_cell")
    below = F.floor(place)
    sides = F.array(
        F.struct(below.alias("at"), (below + 1 - place).alias("w")), F.struct((below + 1).alias("at"), (place - below).alias("w"))
    )
    shares = join_group_values(rows, grid, [group]).withColumn("_side", F.explode(sides)).filter("_side.w > 0")
    kept = [c for c in grid.columns if c != group]
    counted = shares.groupBy(group, F.col("_side.at").alias("_at"), *kept).agg(F.sum("_side.w").alias("_c"))
    weighed = counted.withColumn("_v", F.col("_lo") + F.col("_at") * F.col("_cell"))
    return _kernel_sums(weighed, group, points, math.sqrt(-2 * math.log(tolerance / 100)))


def _curve_grid(rows: DataFrame, group: str, points: int) -> DataFrame:
    """Range, step and bandwidth of every group that has a spread."""
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.stddev_samp("_v").alias("_std"),
    )
    return stats.filter((F.col("_n") > 1) & (F.col("_std") > 0)).select(
        group,
        "_n",
        "_lo",
        "_hi",
        ((F.col("_hi") - F.col("_lo")) / (points - 1)).alias("_step"),
        (F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_std")).alias("_h"),
    )


def _kernel_sums(weighed: DataFrame, group: str, points: int, bandwidths: float) -> DataFrame:
    """The curve from values ``_v`` with weights ``_c``; each adds to the points within reach."""
    place = (F.col("_v") - F.col("_lo")) / F.col("_step")
    reach = F.lit(bandwidths) * F.col("_h") / F.col("_step")
    first = F.greatest(F.lit(0), F.ceil(place - reach)).cast("int")
    last = F.least(F.lit(points - 1), F.floor(place + reach)).cast("int")
    met = F.when(first <= last, F.sequence(first, last))
    spread = weighed.withColumn("point", F.explode(met))
    x = F.col("_lo") + F.col("point") * F.col("_step")
    u = (x - F.col("_v")) / F.col("_h")
    kernel = F.col("_c") * F.exp(-u * u / 2)
    scale = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    summed = spread.groupBy(group, "point", "_lo", "_step", "_n", "_h").agg(F.sum(kernel).alias("_s"))
    return summed.select(group, "point", x.alias("x"), (F.col("_s") / scale).alias("density"))
