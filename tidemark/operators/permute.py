"""A keyed permutation of the row numbers of a group, worked out row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Hexadecimal digits of a digest that make a shift, 48 bits.
DIGITS = 12


def permuted_rank(rank: Column, size: Column, key: Column) -> Column:
    """The place of ``rank`` among the numbers below ``size``, a bijection for every ``key``.

    A Feistel network over a rectangle of near equal sides that just holds the numbers:
    remainder and quotient are shifted in turn by digests of the key and of each other. A
    number that falls outside is permuted again until it falls inside, fewer than
    ``sqrt(size)`` times, which almost no number needs.
    """
    wide = F.ceil(F.sqrt(size)).cast("long")
    high = F.ceil(size / wide).cast("long")

    def shift(turn: int, half: Column) -> Column:
        digest = F.md5(F.concat_ws("|", key, F.lit(str(turn)), half.cast("string")))
        return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")

    def network(number: Column) -> Column:
        halves = F.struct(F.pmod(number, wide).alias("l"), F.floor(number / wide).cast("long").alias("r"))
        for turn in range(ROUNDS):
            def turned(h: Column, turn: int = turn) -> Column:
                left, right = h["l"], h["r"]
                if turn % 2:
                    right = F.pmod(right + shift(turn, left), high)
                else:
                    left = F.pmod(left + shift(turn, right), wide)
                return F.struct(left.alias("l"), right.alias("r"))

            halves = _once(halves, turned)
        return _once(halves, lambda h: h["r"] * wide + h["l"])

    def walked(place: Column) -> Column:
        again = F.aggregate(
            F.sequence(F.lit(1).cast("long"), F.greatest(wide * high - size, F.lit(1))), place,
            lambda at, _: F.when(at < size, at).otherwise(network(at)),
        )
        return F.when(place < size, place).otherwise(again)

    return _once(network(rank.cast("long")), walked)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
