"""Forward-then-backward fill that never orders a whole table in one task."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
PLACE = "_place"
TIE_PLACE = "_tie_place"


def order_number(df: DataFrame, column: str) -> Column:
    """A double that sorts like the column (number, date or timestamp)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return F.col(column).cast("double")


def _bucketed(df: DataFrame, column: str, name: str, cuts: Sequence[float]) -> DataFrame:
    splits = [-math.inf, *sorted(cuts), math.inf]
    return Bucketizer(inputCol=column, outputCol=name, splits=splits, handleInvalid="keep").transform(df)


def with_order_chunks(
    df: DataFrame, order: str, tie: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Add a chunk number that grows with (order, tie).

    Cut points are approximate quantiles of the whole order column (one pass,
    the driver sees only ``chunks`` numbers), so each chunk holds about 1/chunks
    of the rows. An order value so frequent that it fills a chunk of its own is
    cut further by the first tie column, or without one, as its rows then have no
    order, by a hash of the row. Where the cuts fall affects balance only.
    """
    spark = df.sparkSession
    count = max(2, chunks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    probabilities = [i / count for i in range(1, count)]
    error = min(0.001, 0.25 / count)
    placed = df.withColumn(PLACE, order_number(df, order))
    cuts = [c for c in placed.stat.approxQuantile(PLACE, probabilities, error) if math.isfinite(c)]
    heavy = [value for value, times in Counter(cuts).items() if times > 1]
    # A frequent value gets a chunk that holds nothing else.
    edges = {*cuts, *[math.nextafter(v, math.inf) for v in heavy]}
    out = _bucketed(placed, PLACE, CHUNK, edges)
    if heavy and tie:
        tied = out.withColumn(TIE_PLACE, order_number(df, tie[0]))
        crowd = tied.filter(F.col(PLACE).isin(heavy))
        finer = sorted({c for c in crowd.stat.approxQuantile(TIE_PLACE, probabilities, error) if math.isfinite(c)})
        part = _bucketed(tied, TIE_PLACE, "_part", finer)
        inside = F.when(F.col(PLACE).isin(heavy), F.col("_part")).otherwise(F.lit(0.0))
        out = part.withColumn(CHUNK, F.col(CHUNK) * (len(finer) + 2) + inside).drop(TIE_PLACE, "_part")
    elif heavy:
        # The row's place in its scan tells rows apart that agree in all columns.
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *df.columns), F.lit(count))
        inside = F.when(F.col(PLACE).isin(heavy), part).otherwise(0)
        out = out.withColumn(CHUNK, F.col(CHUNK) * count + inside)
    return out.drop(PLACE)


def fill_in_order(
    df: DataFrame,
    values: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Replace nulls by the last earlier value, leading nulls by the first one.

    Rows are cut into ordered chunks. Each chunk reports its first and last
    known value; a running pass over those few reports (one per chunk and
    group) gives the value carried into a chunk; inside a chunk a window does
    the rest. ``tie`` orders rows that share an order value; its first column, a
    number or date, also splits values shared by very many rows. The order
    column must not be null.
    """
    keys = list(keys)
    rank = F.struct(order, *tie) if tie else F.col(order)
    chunked = with_order_chunks(df, order, tie, chunks)

    reports = []
    for value in values:
        known = F.when(F.col(value).isNotNull(), rank)
        reports += [
            F.max_by(value, known).alias(f"_last_{value}"),
            F.min_by(value, known).alias(f"_first_{value}"),
        ]
    report = chunked.groupBy(*keys, CHUNK).agg(*reports)
    # At most one row per chunk and group from here on.
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = report.select(
        *keys,
        CHUNK,
        *[F.last(f"_last_{v}", ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in values],
        *[F.first(f"_first_{v}", ignorenulls=True).over(whole).alias(f"_lead_{v}") for v in values],
    )

    # Null keys are a group of their own, as in the window below.
    joined = chunked.alias("c").join(
        carried.alias("k"),
        [F.col(f"c.{k}").eqNullSafe(F.col(f"k.{k}")) for k in [*keys, CHUNK]],
        "left",
    )
    inside = Window.partitionBy(*[f"c.{k}" for k in [*keys, CHUNK]]).orderBy(*[f"c.{c}" for c in [order, *tie]])
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        v: F.coalesce(
            F.last(F.col(f"c.{v}"), ignorenulls=True).over(inside), F.col(f"k._carry_{v}"), F.col(f"k._lead_{v}")
        )
        for v in values
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(f"c.{c}") for c in df.columns])


def fill_by_date(df: DataFrame, values: Sequence[str], date: str) -> DataFrame:
    """Fill columns that are a function of the date (a joined dimension label).

    The distinct dates of a monthly panel form a spine as long as the calendar,
    so the fill is ordered there and joined back, never over the fact rows.
    """
    known = [F.min(v).alias(v) for v in values]
    spine = df.filter(F.col(date).isNotNull()).groupBy(date).agg(*known)
    earlier = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = spine.select(
        date,
        *[
            F.coalesce(
                F.last(v, ignorenulls=True).over(earlier), F.first(v, ignorenulls=True).over(everything)
            ).alias(f"_{v}")
            for v in values
        ],
    )
    joined = df.join(filled, date, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in values else F.col(c) for c in df.columns])
