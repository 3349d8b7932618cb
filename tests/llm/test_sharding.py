from __future__ import annotations

import hashlib
import math
import zlib

import pytest
from llm_rows import EDGE, make
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.numbering import number_rows


def brute_place(number: int, rows: int, seed: int = 42) -> int:
    wide = math.isqrt(max(rows - 1, 0)) + 1
    high = -(-rows // wide)

    def shift(turn, half):
        return int(hashlib.md5(f"{seed}:{turn}:{half}".encode()).hexdigest()[:12], 16)

    while True:
        left, right = number % wide, number // wide
        for turn in range(4):
            if turn % 2:
                right = (right + shift(turn, left)) % high
            else:
                left = (left + shift(turn, right)) % wide
        number = right * wide + left
        if number < rows:
            return number


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 7, 30, 101, 1000])
def test_permutation_and_its_inverse(spark, rows):
    df = spark.range(rows).withColumn("place", sharding.permuted(F.col("id"), rows))
    got = {r.id: r.place for r in df.collect()}
    assert sorted(got.values()) == list(range(rows))
    assert got == {i: brute_place(i, rows) for i in range(rows)}
    back = df.withColumn("back", sharding.permuted(F.col("place"), rows, back=True))
    assert back.filter("back != id").count() == 0


def brute_shards(rows, shards):
    def key(row):
        return hashlib.md5(f"{'-' if row[0] is None else row[0]}:{row[1] or ''}".encode()).hexdigest()

    out = []
    for number, (doc, text) in enumerate(sorted(rows, key=key)):
        place, body = brute_place(number, len(rows)), (text or "").encode()
        out.append((doc, len(body) + 16, zlib.crc32(body), number, place, place % shards, place // shards))
    return sorted(out, key=repr)


def test_matches_brute_force_on_edge_rows(spark, edge, empty):
    rows = [(d, t) for d, t, *_ in EDGE]
    got = sharding.assign_shards(edge, shards=4).collect()
    # Of rows with equal digests either may take either place.
    plain = [[x for i, x in enumerate(r) if i not in (0,)] for r in map(tuple, got)]
    wanted = [[x for i, x in enumerate(r) if i not in (0,)] for r in brute_shards(rows, 4)]
    assert sorted(plain) == sorted(wanted)
    assert sorted(repr(r.id) for r in got) == sorted(repr(d) for d, _ in rows)
    assert sharding.assign_shards(empty).count() == 0


def test_laws_with_repeated_rows(spark):
    rows = [(i % 50 if i % 3 else 7, "same" if i % 3 == 0 else f"text {i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.assign_shards(df, shards=7).collect()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, found), key=repr) == brute_shards(rows, 7)
    again = sharding.assign_shards(df.repartition(3), shards=7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    df = make(spark, EDGE * 3)
    sharding.write_shards(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select("record.*").collect())) == sorted(map(repr, df.collect()))
    wanted = sharding.assign_shards(df, shards=3)
    key = lambda r: (repr(r[0]), r[1], r[2])
    got = back.select("record.doc_id", "shard", "slot").collect()
    assert sorted(map(key, got)) == sorted(map(key, wanted.select("id", "shard", "slot").collect()))


def test_numbers_within_groups(spark):
    rows = [(("a", "b", "c")[min(i % 7, 2)], (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    got = number_rows(df, ["v"], "g").collect()
    for group in "abc":
        ordered = sorted((r["index"], r["v"]) for r in got if r.g == group)
        assert [i for i, _ in ordered] == list(range(len(ordered)))
        assert [v for _, v in ordered] == sorted(v for g, v in rows if g == group)
    whole = sorted((r["index"], r["v"]) for r in number_rows(df.drop("g"), ["v"]).collect())
    assert whole == list(enumerate(sorted(v for _, v in rows)))
