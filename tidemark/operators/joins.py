"""N-way merges, dimension look-ups, unions and semi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

# Largest group table that is broadcast, in rows and in bytes of its JSON text.
BROADCAST_GROUPS = 100_000
BROADCAST_BYTES = 8_000_000

HOWS = ("inner", "outer", "left", "right")


def merge_two(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "outer") -> DataFrame:
    """Join on equal keys, null keys matching each other.

    Key columns come first and are coalesced; other columns that both sides
    have get the suffixes ``_x`` and ``_y``.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.select([F.col(f"`{c}`").alias(f"{c}_x" if c in shared else c) for c in left.columns]).alias("l")
    r = right.select([F.col(f"`{c}`").alias(f"{c}_y" if c in shared else c) for c in right.columns]).alias("r")
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    joined = l.join(r, condition, "full" if how == "outer" else how)
    if how == "outer":
        key_columns = [F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys]
    else:
        side = "r" if how == "right" else "l"
        key_columns = [F.col(f"{side}.{k}").alias(k) for k in keys]
    rest = [F.col(f"l.{c}") for c in l.columns if c not in keys]
    rest += [F.col(f"r.{c}") for c in r.columns if c not in keys]
    return joined.select(*key_columns, *rest)


def merge_on_keys(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "outer") -> DataFrame:
    """Merge tables left to right on a set of keys."""
    if not frames:
        raise ValueError("frames must be a non-empty list")
    if not keys:
        raise ValueError("keys must be a non-empty list")
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    return reduce(lambda a, b: merge_two(a, b, keys, how), frames)


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float, most: int = 256) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows, found by a sketch of frequent items.

    At most ``1 / share`` keys can; the sketch may name a few that hold a little less.
    """
    hashed = df.select(F.xxhash64(*keys).alias("k"))
    top = F.call_function("approx_top_k", F.col("k"), F.lit(min(most, int(1 / share) + 1)), F.lit(16 * most))
    found = hashed.agg(F.count("*").alias("n"), top.alias("top")).first()
    return sorted(row["item"] for row in found["top"] or [] if row["count"] > share * found["n"])


def merge_heavy(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "outer", share: float = 0.01, salts: int = 32
) -> DataFrame:
    """``merge_two`` where a key, null included, may hold a large share of the rows.

    Adaptive execution does not split a full join's keys. So the keys that hold more than
    ``share`` of either side are merged apart: those that both sides have match in all rows,
    so an inner join does, the left rows dealt over ``salts`` parts and the right ones copied
    to each; those of one side alone need no join. All other keys are merged as ever.
    """
    hot = sorted({*heavy_keys(left, keys, share), *heavy_keys(right, keys, share)})
    if not hot:
        return merge_two(left, right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    cold = merge_two(left.filter(~is_hot), right.filter(~is_hot), keys, how)
    (l, r) = (side.filter(is_hot) for side in (left, right))
    # As many rows as hot keys, 2 / share at most.
    listed = [F.broadcast(side.select(*keys).distinct()) for side in (l, r)]

    def matched(rows: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        named = other.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
        return rows.join(named, same, kind)

    both_l, both_r = matched(l, listed[1], "left_semi"), matched(r, listed[0], "left_semi")
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = merge_two(both_l.withColumn("_salt", deal), both_r.withColumn("_salt", parts), [*keys, "_salt"], "inner")
    frames = [cold, salted.drop("_salt")]
    # With an empty other side a merge only names and adds the columns.
    if how in ("outer", "left"):
        frames.append(merge_two(matched(l, listed[1], "left_anti"), r.limit(0), keys, "left"))
    if how in ("outer", "right"):
        frames.append(merge_two(l.limit(0), matched(r, listed[0], "left_anti"), keys, "right"))
    return stack_frames(frames)


def attach_dimension(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of dimension columns.

    No broadcast is forced: the planner broadcasts a dimension whose measured
    size is small and shuffles otherwise, splitting skewed fact keys.
    """
    return facts.join(dimension.select(*keys, *columns), list(keys), "left")


def join_group_values(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_GROUPS
) -> DataFrame:
    """Join one row of values per group back to the rows.

    The group table is computed once and kept in the checkpoint folder. With at
    most ``limit`` groups and ``BROADCAST_BYTES``, both measured, it is broadcast, so the rows stay where they
    are; with more, both sides are shuffled and adaptive execution splits the
    keys that hold too many rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    held = groups.checkpoint()
    size = held.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    if size["n"] <= limit and (size["bytes"] or 0) <= BROADCAST_BYTES:
        held = F.broadcast(held)
    return rows.join(held, list(keys), how)


def top_groups(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys with most non-null values; ties go to the smaller key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("n"))
    return counts.orderBy(F.col("n").desc(), key).limit(k)


def keep_top_groups(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Rows of the k largest groups. The broadcast side has exactly k rows."""
    return df.join(F.broadcast(top_groups(df, key, value, k).select(key)), key, "left_semi")


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
