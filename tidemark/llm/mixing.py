"""Mixing sources to target weights by pivotal dependent rounding.

A source's ratio of target to size gives each of its texts whole copies and a
fraction. Fractions are rounded two at a time: mass, counted in words, moves at
random from one text to the other until one fraction is 0 or 1, which keeps the
sum of words and, on average, every fraction. Each task rounds the texts of its
chunk of a source in a stream and is left with one fraction at most; the fractions
left meet in a tree of such steps until one per source remains, and that text
gives its fraction in words, so that the source meets its target to a word.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, keep_sized, text_or_empty
from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

#: Rows of a source that one task rounds in the first step, and fractions in a later one.
CHUNK = 4096
FAN_IN = 256
#: A fraction this near to 0 or 1 counts as whole.
NEAR = 1e-12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in order of their code points, null last, take the weights in turn and
    share the sum of all sizes. A target stops at ``most`` times its source's size;
    the excess is shared again by weight until none is above. The table has one row
    per source; each round is one aggregation over it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = keep_table(
        sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
            "cap", F.col("source_size") * most
        )
    )
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # Per unit of weight; every round closes at least one more source.
    rate = total / float(ranked.agg(F.sum("weight")).first()[0] or 1.0)
    while True:
        closed = F.col("weight") * F.lit(rate) >= F.col("cap")
        sums = ranked.agg(
            F.sum(F.when(closed, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(~closed, F.col("weight")).otherwise(0.0)).alias("open"),
        ).first()
        following = (total - sums["taken"]) / sums["open"] if sums["open"] else rate
        if following <= rate * (1 + 1e-12):
            break
        rate = following
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(rate), "cap").alias("target"))


def pivot(left: tuple, right: tuple, draw: float) -> tuple[tuple, tuple]:
    """One step between two fractions ``(size, share)``.

    Either ``right`` gives ``left`` as many words as fit, or the other way round,
    with the chances that leave both shares unchanged on average.
    """
    (m, p), (n, q) = left, right
    up = min(m * (1 - p), n * q)
    down = min(m * p, n * (1 - q))
    moved = up if draw * (up + down) < down else -down
    return (m, p + moved / m), (n, q - moved / n)


class Rounder:
    """Rounds a stream of fractions, holding the one that is still open."""

    def __init__(self, seed: str) -> None:
        self.draw = random.Random(seed).random
        self.open: tuple | None = None

    def add(self, key, size: float, share: float) -> Iterator[tuple]:
        """Yields ``(key, 0 or 1)`` of what became whole."""
        if share <= NEAR or share >= 1 - NEAR or size <= 0:
            yield key, int(share > 0.5 and size > 0)
            return
        if self.open is None:
            self.open = (key, size, share)
            return
        old, m, p = self.open
        (_, p), (_, share) = pivot((m, p), (size, share), self.draw())
        self.open = None
        for one in ((old, m, p), (key, size, share)):
            if one[2] <= NEAR or one[2] >= 1 - NEAR:
                yield one[0], int(one[2] > 0.5)
            else:
                self.open = one


def round_chunks(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One step of the tree over ``source_key``, ``chunk``, ``draw``, ``key``, ``size``, ``share``.

    Returns the rows without ``draw``; the share is 0 or 1 or, for one row at most of
    a chunk, still a fraction. The rows of a chunk come in the order of ``draw``, and
    the chunk's name seeds its random numbers, so reruns agree.
    """
    names = ["source_key", "chunk", "key", "size", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rounder, out, kinds = None, None, [], None

        def close() -> None:
            if rounder is not None and rounder.open is not None:
                (key, size), _, share = rounder.open
                out.append((*at, key, size, share))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            kinds = batch.schema.types
            for source, chunk, key, size, share in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (source, chunk):
                    close()
                    at, rounder = (source, chunk), Rounder(f"{seed}:{level}:{source}:{chunk}")
                for (done, n), whole in rounder.add((key, size), float(size), share):
                    out.append((source, chunk, done, n, float(whole)))
            yield flush()
        if rounder is not None:
            close()
            yield flush()

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.repartition(partitions, "source_key", "chunk")
        .sortWithinPartitions("source_key", "chunk", "draw", "key", "size")
        .select(*names)
        .mapInArrow(run, f"source_key long, chunk long, key {kind}, size long, share double")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    seed: int = 42,
    chunk: int = CHUNK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every row.

    ``size`` is the number of words of the whole text, 0 for a null text. ``taken`` is
    the words that the mix takes: whole copies of the text and, for the one text of a
    source that stays fractional, that part of one more copy. So a source's ``taken``
    sums to its target but for rounding to a word, and no row exceeds ``most`` times
    its size, rounded up. A null source is a source of its own, the last. Repeated
    rows are rounded one by one; null ids are kept; an empty table gives an empty
    result; other columns are not read.
    """
    body = text_or_empty(text)
    rows = keep_table(
        docs.select(
            F.col(id_column).alias("key"),
            F.col(source).cast("string").alias("source"),
            word_count(body).alias("size"),
            F.xxhash64(F.col(id_column), F.lit(seed), body).alias("draw"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sizes = keep_table(sizes.withColumn("source_key", F.xxhash64(F.lit("source"), "source")))
    aimed = targets(sizes.select("source", "source_size"), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    known = keep_sized(
        sizes.withColumnRenamed("source", "name")
        .join(aimed.select(F.col("source").alias("aim"), "target"), F.col("name").eqNullSafe(F.col("aim")))
        .select(
            "name", "source_key", "source_size", "target", ratio.alias("ratio"),
            F.ceil(F.col("rows") / chunk).cast("long").alias("chunks"),
        )
    )
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        "source_key", F.pmod("draw", "chunks").alias("chunk"), "draw", "key", "size",
        (F.col("ratio") - F.floor("ratio")).alias("share"),
    )
    leaves = keep_table(round_chunks(placed, seed, 0))
    partial = (F.col("share") > NEAR) & (F.col("share") < 1 - NEAR)
    left = leaves.filter(partial).select(
        "source_key", F.col("chunk").alias("key"), F.col("chunk"), "size", "share"
    )
    settled = None
    level, chunks = 0, known.agg(F.max("chunks")).first()[0] or 1
    while chunks > 1:
        level, chunks = level + 1, -(-chunks // fan_in)
        met = left.withColumn("chunk", F.floor(F.col("chunk") / fan_in)).withColumn(
            "draw", F.xxhash64("key", F.lit(seed), F.lit(level))
        )
        done = keep_table(round_chunks(met, seed, level))
        whole = done.filter(~partial)
        settled = whole if settled is None else settled.union(whole)
        left = done.filter(partial)
    settled = left if settled is None else settled.union(left)
    settled = keep_sized(
        settled.select(F.col("source_key").alias("of"), F.col("key").alias("of_chunk"), F.col("share").alias("final"))
    )
    joined = leaves.withColumn("partial", partial).join(
        settled, (F.col("source_key") == F.col("of")) & (F.col("chunk") == F.col("of_chunk")) & F.col("partial"), "left"
    )
    share = F.coalesce("final", "share")
    whole = F.when(share >= 1 - NEAR, 1).otherwise(0).cast("long")
    part = F.when((share > NEAR) & (share < 1 - NEAR), F.round(share * F.col("size"))).otherwise(0).cast("long")
    copies = F.floor("ratio") + whole
    return joined.join(known, "source_key").select(
        F.col("key").alias("id"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size") + part).alias("taken"),
    )
