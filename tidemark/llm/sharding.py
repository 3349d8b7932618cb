"""A reproducible shuffle of all rows into shards, by a permutation of row numbers.

Rows are numbered from 0 in the order of a digest of their id and text. A Feistel
network permutes the numbers: a number is split into a remainder and a quotient,
which are shifted in turn by keyed digests of each other. Its domain is the least
rectangle of near equal sides that holds all numbers; a number that falls outside
the table is permuted again until it falls inside (cycle walking). The place of a
row is then known from its number alone: shard and slot are the remainder and the
quotient by the number of shards, and the inverse gives the row of a slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.numbering import number_rows
from tidemark.llm.quality import bound_once
from tidemark.session import keep_table

ROUNDS = 4
#: Hexadecimal digits of a digest that make a shift, 48 bits.
DIGITS = 12
#: Bytes that a row takes beside its text.
OVERHEAD = 16


def sides(rows: int) -> tuple[int, int]:
    """Sides of the least rectangle of near equal sides with at least ``rows`` cells."""
    wide = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return wide, max(1, -(-rows // wide))


def _shift(turn: Column, half: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), turn.cast("string"), F.lit(":"), half.cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def _network(number: Column, rows: int, seed: int, back: bool) -> Column:
    """All rounds once, forward or back, on a number of the rectangle."""
    wide, high = sides(rows)
    sign = -1 if back else 1

    def turned(halves: Column, turn: Column) -> Column:
        left, right = halves["left"], halves["right"]
        of_left = F.pmod(left + sign * _shift(turn, right, seed), F.lit(wide)).alias("left")
        of_right = F.pmod(right + sign * _shift(turn, left, seed), F.lit(high)).alias("right")
        return F.when(turn % 2 == 0, F.struct(of_left, right.alias("right"))).otherwise(
            F.struct(left.alias("left"), of_right)
        )

    turns = range(ROUNDS)[::sign]
    start = F.struct((number % wide).alias("left"), F.floor(number / wide).cast("long").alias("right"))
    return F.aggregate(
        F.array(*[F.lit(t) for t in turns]), start, turned, lambda halves: halves["right"] * wide + halves["left"]
    )


def permuted(number: Column, rows: int, seed: int = 42, back: bool = False) -> Column:
    """The place of a row number among ``rows`` numbers, or with ``back`` the number at a place.

    A walk leaves the table at most as often as there are cells outside of it, fewer
    than the square root of ``rows``, plus one. All but about that many rows are inside
    after the first step and walk no further.
    """
    wide, high = sides(rows)
    outside = wide * high - rows
    first = _network(number.cast("long"), rows, seed, back)
    if not outside:
        return first

    def walked(place: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            return F.when(at < rows, at).otherwise(_network(at, rows, seed, back))

        again = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), place, step)
        return F.when(place < rows, place).otherwise(again)

    return bound_once(first, walked)


def row_key(id_column: Column, text: Column) -> Column:
    """What rows are numbered by: a digest of id and text, ``-`` for a null id."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("-")), F.lit(":"), text))


def _placed(numbered: DataFrame, rows: int, shards: int, seed: int) -> DataFrame:
    place = permuted(F.col("index"), rows, seed)
    return numbered.withColumn("position", place).withColumns(
        {
            "shard": (F.col("position") % shards).cast("int"),
            "slot": F.floor(F.col("position") / shards).cast("long"),
        }
    )


def assign_shards(
    docs: DataFrame, shards: int = 40, seed: int = 42, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``index``, ``position``, ``shard`` and ``slot`` of every row.

    ``size`` is the UTF-8 bytes of the text and 16 more. Shards differ by one row at
    most, and slots of a shard run from 0 without a gap. A null text counts as empty.
    Rows that repeat id and text get places of their own, and which of them takes which
    makes no difference to the result; null ids are kept; an empty table gives an empty
    result; other columns are not read.
    """
    body = text_or_empty(text)
    # Texts are read once; sampling the key ranges and counting read the kept digests.
    facts = keep_table(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
            F.crc32(body).cast("long").alias("text_crc32"),
            row_key(F.col(id_column), body).alias("key"),
        )
    )
    numbered = number_rows(facts, ["key"])
    return _placed(numbered, facts.count(), shards, seed).drop("key")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 40,
    seed: int = 42,
    text: str = "text",
    id_column: str = "doc_id",
) -> None:
    """Write whole rows to ``path``: one folder for each shard, rows as ``slot`` and ``record``.

    The files of a shard hold ascending ranges of its slots, so one shard is written by
    several tasks. Rows that agree in id and text are told apart by a hash of all columns,
    so a rerun writes the same rows at the same slots.
    """
    body = text_or_empty(text)
    packed = docs.select(F.struct("*").alias("record"), row_key(F.col(id_column), body).alias("key"))
    numbered = number_rows(packed.withColumn("other", F.xxhash64("record")), ["key", "other"])
    ordered = _placed(numbered, numbered.count(), shards, seed).repartitionByRange("shard", "slot")
    ordered.sortWithinPartitions("shard", "slot").select("shard", "slot", "record").write.partitionBy("shard").parquet(path)
