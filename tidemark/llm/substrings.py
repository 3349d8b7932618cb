"""Exact removal of repeated passages, found through difference-cover anchors.

Two equal windows of ``size`` words stand at any two word positions i and j. A
difference cover D of the period v has, for every i and j, an offset below v that
takes both into D. So hashing only the windows of size - v + 1 words that start at
positions in D modulo v is enough: any two equal long windows share an aligned
anchor. With v = 21 an anchor stands at 5 of 21 positions.

Anchors whose hash occurs twice mark candidate windows; these are extended to the
full window, hashed with 128 bits, and kept if that hash occurs twice. Nothing
else is hashed at every position or shuffled, and no pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

# Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
# Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
NO_TEXT = hashlib.sha256(b"").hexdigest()


def cover_of(size: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least two fifths of the window."""
    fitting = [v for v in COVERS if v <= 0.6 * size]
    return (max(fitting), COVERS[max(fitting)]) if fitting else (1, (0,))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class Roller:
    """Hashes of windows of words, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.room = 0

    def powers(self, n: int) -> None:
        if n > self.room:
            self.room = max(n, 2 * self.room, 4096)
            self.up, self.down = (
                [np.cumprod(np.r_[np.uint64(1), np.full(self.room, b, np.uint64)]) for b in bases]
                for bases in (BASES, INVERSES)
            )

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        self.powers(len(words))
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def windows(self, hashes: np.ndarray, starts: np.ndarray, size: int, lane: int) -> np.ndarray:
        mixed = hashes if not lane else (hashes ^ (hashes >> np.uint64(31))) * np.uint64(BASES[1])
        sums = np.r_[np.uint64(0), np.cumsum(mixed * self.up[lane][: len(mixed)])]
        value = (sums[starts + size] - sums[starts]) * self.down[lane][starts]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        return (value ^ (value >> np.uint64(32))).view(np.int64)


HASHED = "k1 long, k2 long, mark long, pos int, route long, known boolean"


def dealt(k1: np.ndarray, k2: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows for ``repeated``: within a batch, one row of each hash goes to that hash's place.

    The others are known to repeat and go anywhere, so a hash that stands a
    million times costs its reader one row per batch.
    """
    order = np.lexsort((pos, mark, k2, k1))
    k1, k2, mark, pos = k1[order], k2[order], mark[order], pos[order]
    n = len(k1)
    first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if n else np.empty(0, bool)
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    differs = (mark != mark[starts][run]) | (pos != pos[starts][run]) if n else first
    known = np.logical_or.reduceat(differs, starts)[run] if n else first
    keep = first | known
    spread = (mark ^ pos.astype(np.int64) * np.int64(0x9E3779B1)) * np.int64(0x85EBCA6B)
    route = np.where(first, k1, spread)
    names = [c.split()[0] for c in HASHED.split(", ")]
    columns = [a[keep] for a in (k1, k2, mark, pos, route, known)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def gathered(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return dealt(*(np.concatenate(c) for c in zip(*parts)))


def repeated(rows: DataFrame) -> DataFrame:
    """``(mark, pos)`` of rows whose hash stands at two or more places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open run: its key, its first place, and whether it is known to repeat.
        key, place, proven = None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k1, k2, mark, pos, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            starts = np.flatnonzero(first)
            ids = np.cumsum(first) - 1
            lead_mark, lead_pos = mark[starts].copy(), pos[starts].copy()
            goes_on = key == (k1[0], k2[0])
            if goes_on:
                lead_mark[0], lead_pos[0] = place
            differs = (mark != lead_mark[ids]) | (pos != lead_pos[ids])
            twice = np.logical_or.reduceat(differs, starts)
            if goes_on and twice[0] and not proven:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[0]], pa.int64()), pa.array([place[1]], pa.int32())], names=["mark", "pos"]
                )
            if goes_on:
                twice[0] |= proven
            found = twice[ids] | known
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(mark[found]), pa.array(pos[found])], names=["mark", "pos"])
            key, place, proven = (k1[-1], k2[-1]), (int(lead_mark[-1]), int(lead_pos[-1])), bool(twice[-1])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(partitions, "route")
        .select("k1", "k2", "mark", "pos", "known")
        .sortWithinPartitions("k1", "k2", "mark", "pos")
        .mapInArrow(run, "mark long, pos int")
    )


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """Hashes of the windows at cover positions, of each distinct text of a partition."""
    period, cover = cover_of(size)
    length = size - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen = Roller(), set()
        for batch in batches:
            parts = []
            for mark, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if mark in seen:
                    continue
                seen.add(mark)
                words = split_words(body.as_py())
                if len(words) < size:
                    continue
                base = np.arange(0, len(words) - length + 1, period)
                starts = (base[:, None] + np.array(cover)).ravel()
                starts = starts[starts <= len(words) - length]
                k1 = roller.windows(roller.word_hashes(words), starts, length, 0)
                n = len(starts)
                parts.append((k1, np.zeros(n, np.int64), np.full(n, mark), starts.astype(np.int32)))
            if parts:
                yield gathered(parts)

    return texts.select("mark", "body").mapInArrow(run, HASHED)


def candidate_windows(held: DataFrame, size: int) -> DataFrame:
    """Hashes of all full windows that hold a repeated anchor."""
    period, _ = cover_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            parts = []
            for mark, body, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = split_words(body.as_py())
                found = at.values.to_numpy(zero_copy_only=False)
                starts = (found[:, None] - np.arange(period)).ravel()
                inside = np.zeros(len(words) - size + 1, bool)
                inside[starts[(starts >= 0) & (starts < len(inside))]] = True
                starts = np.flatnonzero(inside)
                hashes = roller.word_hashes(words)
                k1, k2 = (roller.windows(hashes, starts, size, lane) for lane in (0, 1))
                parts.append((k1, k2, np.full(len(starts), mark), starts.astype(np.int32)))
            if parts:
                yield gathered(parts)

    return held.select("mark", "body", "at").mapInArrow(run, HASHED)


def kept_words(words: list[bytes], starts: np.ndarray, size: int) -> list[bytes]:
    """The words that no window of ``size`` starting at ``starts`` covers."""
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] = 1
    ends = np.unique(starts) + size
    np.subtract.at(edges, ends, 1)
    free = np.cumsum(edges[:-1]) == 0
    return [w for w, f in zip(words, free.tolist()) if f]


def removal(held: DataFrame, size: int) -> DataFrame:
    """``mark``, ``n_removed``, ``kept`` (the words left) of the texts with repeated windows at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for body, at in zip(batch.column(1), batch.column(2)):
                words = split_words(body.as_py())
                left = kept_words(words, at.values.to_numpy(zero_copy_only=False), size)
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["mark", "n_removed", "kept"],
            )

    return held.select("mark", "body", "at").mapInArrow(run, "mark long, n_removed long, kept string")


def drop_repeated_passages(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 35, keep_text: bool = True
) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept`` of every row.

    A window is ``size`` consecutive words of one text. Every word in a window
    whose words also start anywhere else, in the same or another row, is removed;
    windows are judged on the input. ``kept`` joins the words left by one space.

    A null text has no words. Equal texts in two rows remove each other if they
    have ``size`` words or more, so repeated rows do too. Null ids are kept, an
    empty table gives an empty result, other columns are not read.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(id_column).alias("id"), body.alias("body")).withColumn("mark", F.xxhash64("body"))
    texts = rows.select("mark", "body")

    found = repeated(anchors(texts, size)).groupBy("mark").agg(F.array_distinct(F.collect_list("pos")).alias("at"))
    first = texts.mapInArrow(first_of_each, "mark long, body string")
    held = keep_table(first.join(found, "mark"))
    places = repeated(candidate_windows(held, size)).groupBy("mark").agg(
        F.array_distinct(F.collect_list("pos")).alias("at")
    )
    # One row per text: copies from different partitions met in the table.
    once = held.select("mark", "body").join(places, "mark").dropDuplicates(["mark"])
    cut = removal(once, size).select(
        "mark", F.col("n_removed").alias("cut"), F.sha2("kept", 256).alias("cut_sha"),
        *([F.col("kept").alias("cut_text")] if keep_text else []),
    )
    copies = rows.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark", F.lit(True).alias("copied"))
    changes = cut.join(copies, "mark", "full")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, kept = [], [], []
            for value in batch.column(2):
                words = split_words(value.as_py())
                joined = b" ".join(words)
                counts.append(len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept.append(joined.decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "mark", "n_words", "sha"]
            if keep_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("plain")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    whole = rows.select("id", "mark", "body").mapInArrow(
        plain, f"id {kind}, mark long, n_words long, sha string" + (", plain string" if keep_text else "")
    )
    joined = whole.join(changes, "mark", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_words") >= size)
    columns = [
        "id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(NO_TEXT)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.coalesce("cut_text", "plain")).alias("kept"))
    return joined.select(*columns)


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each distinct text of a partition."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, mark in enumerate(batch.column(0).to_pylist()):
            if mark not in seen:
                seen.add(mark)
                fresh.append(i)
        yield batch.take(pa.array(fresh, pa.int64()))
