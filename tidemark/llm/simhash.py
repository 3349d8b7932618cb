"""SimHash near-duplicates, and near-duplicates by exact similarity of shingle sets.

``near_duplicates``: block keys, a join on them, Hamming verification. Distinct
fingerprints are compared, so exact copies cost one row per class. The bits are
split into m blocks and every choice of m - d blocks is a key (``pigeonhole_masks``).
Two fingerprints that differ in d bits leave m - d blocks equal, so no link is
lost. m grows with the number of fingerprints, so that a key is shared by few
unrelated ones. Rows with equal keys meet in a sorted stream and are verified by
XOR and bit counts. A key with more than ``BUCKET`` rows is cut into chunks and
each pair of chunks is compared on its own, so no task holds a whole hot bucket;
from a dense bucket only a spanning forest of its links is returned, which leaves
the components unchanged.

``drop_near_duplicates``: the same fingerprints, block keys and Hamming verification find
near texts, which are then compared shingle by shingle. Similar sets may have
fingerprints that lie further apart, so a prefix join on the sets finds the rest: a text
is listed under the rarest of its shingles, so many that two sets of the similarity share
one of them. Texts that meet and are not joined yet are told apart by the Hamming distance of
parity fingerprints, which is never more than the number of shingles in one set alone, and
what is left is compared shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_sized, text_or_empty
from tidemark.llm.components import components
from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

LANE = 64
#: Rows of one key that are compared in one go.
BUCKET = 2048
#: Unrelated fingerprints that may share a key with one, on average. More of them cost
#: comparisons in memory, fewer cost keys and so shuffled rows.
CROWD = 16
#: Shingles hashed at once, which bounds memory on very long texts.
SHINGLES = 1 << 16
#: Runs up to this length are compared by shifting the rows of a batch against themselves.
SHORT_RUN = 128
SEED = 42
#: Rows that are sampled for common shingles, one in so many at most, and shingles kept.
SAMPLE_ROWS, SAMPLE_SHARE, COMMON = 20_000, 16, 200_000
#: Texts of a frequent shingle that are dealt to one part, and texts compared with one at a time.
HEAVY, LEAVES = 20_000, 64
#: Words of 64 bits of a parity fingerprint, and the largest set whose postings carry one word of it.
PARITY_LANES, PARITY_SET = 8, 96


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` lower-cased words, in blocks; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    count = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    for first in range(0, count, SHINGLES):
        part = words[first : first + SHINGLES + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        n = min(SHINGLES, count - first)
        starts = (ends - lengths)[:n].tolist()
        stops = ends[size - 1 :].tolist() if len(part) >= size else [len(joined)]
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def lane_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 has the hashes themselves, the others are mixed from them."""
    if not lane:
        return hashes
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def fingerprint(text: str, size: int, lanes: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes; all 0 without words."""
    counts, total = np.zeros((lanes, LANE), np.int64), 0
    for hashes in shingle_hashes(text, size):
        total += len(hashes)
        for lane in range(lanes):
            octets = np.ascontiguousarray(lane_hashes(hashes, lane)).view(np.uint8).reshape(-1, 8)
            counts[lane] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.int64).ravel()


def lane_names(bits: int) -> list[str]:
    return [f"l{i}" for i in range(bits // LANE)]


def fingerprints(docs: DataFrame, text: str, id_column: str, size: int, bits: int) -> DataFrame:
    """``id``, ``mark`` (a hash of the text) and the fingerprint's lanes ``l0``.. of every row."""
    lanes = bits // LANE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.empty((batch.num_rows, lanes), np.int64)
            for i, body in enumerate(batch.column(2)):
                prints[i] = fingerprint(body.as_py(), size, lanes)
            columns = [batch.column(0), batch.column(1), *(pa.array(prints[:, k]) for k in range(lanes))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", *lane_names(bits)])

    body = text_or_empty(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark long, " + ", ".join(f"{c} long" for c in lane_names(bits)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def lane_masks(chosen: list[int], bits: int) -> tuple[int, ...]:
    return tuple(
        signed(sum(1 << (b - LANE * lane) for b in chosen if b // LANE == lane)) for lane in range(bits // LANE)
    )


def pigeonhole_masks(bits: int, distance: int, rows: int) -> list[tuple[int, ...]]:
    """Masks of which any two fingerprints within ``distance`` agree on at least one."""
    for parts in range(distance + 1, bits + 1):
        cuts = [round(bits * i / parts) for i in range(parts + 1)]
        blocks = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        choices = list(combinations(blocks, parts - distance))
        crowd = sum(rows / 2.0 ** sum(map(len, c)) for c in choices)
        if crowd <= CROWD or math.comb(parts + 1, distance) > 1000:
            return [lane_masks([b for block in c for b in block], bits) for c in choices]
    raise ValueError("the distance must be less than the number of bits")


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which rows of lanes differ; counted on unsigned words, as a signed count drops the sign."""
    return np.bitwise_count((left ^ right).view(np.uint64)).sum(axis=1, dtype=np.int64)


def linked(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a set of fingerprints, as index pairs."""
    free = np.arange(len(prints))
    left, right = [], []
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            at = front.pop()
            near = differing(prints[free], prints[at]) <= distance
            if near.any():
                found, free = free[near], free[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                front.extend(found)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which links join what was not joined before; the others add nothing to the components."""
    root: dict[int, int] = {}
    keep = np.zeros(len(left), bool)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while (up := root.get(a, a)) != a:
            root[a] = a = root.get(up, up)
        while (up := root.get(b, b)) != b:
            root[b] = b = root.get(up, up)
        if a != b:
            root[a] = b
            keep[i] = True
    return keep


def run_links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys, at most one fewer than rows; the rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    lengths = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    short = lengths <= SHORT_RUN
    ends = np.repeat(starts + lengths, lengths)
    rows = np.flatnonzero(np.repeat(short, lengths))
    for step in range(1, SHORT_RUN):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        near = differing(prints[rows], prints[rows + step]) <= distance
        left.append(rows[near])
        right.append(rows[near] + step)
    for start, length in zip(starts[~short].tolist(), lengths[~short].tolist()):
        a, b = linked(prints[start : start + length], distance)
        left.append(a + start)
        right.append(b + start)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    keep = forest(all_left, all_right)
    return all_left[keep], all_right[keep]


def block_rows(classes: DataFrame, lanes: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """One row per fingerprint and mask: the mask's number and a hash of the bits it takes."""
    keys = [
        F.struct(
            F.lit(i).alias("mask"),
            F.xxhash64(*[F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(lanes, mask) if m]).alias("key"),
        )
        for i, mask in enumerate(masks)
    ]
    return classes.select(*lanes, F.explode(F.array(*keys)).alias("at")).select(*lanes, "at.*")


def links(classes: DataFrame, lanes: list[str], masks: list[tuple[int, ...]], distance: int) -> DataFrame:
    """Verified links between distinct fingerprints, enough to join every component."""
    width = len(lanes)
    blocked = block_rows(classes, lanes, masks)
    # Keys with more than BUCKET rows: at most one in BUCKET rows makes one.
    crowded = keep_sized(
        blocked.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
        .select("mask", "key", F.ceil(F.col("n") / BUCKET).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64(*lanes, F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = (
        blocked.join(crowded, ["mask", "key"], "left")
        .withColumn("chunk", F.when(F.col("chunks").isNotNull(), chunk).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
        .select("mask", "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), *lanes)
    )
    names = [f"u{i}" for i in range(width)] + [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(table):
                continue
            held = table if held is None else np.concatenate([held, table])
            # The last key may go on in the next batch; a key has at most two chunks of rows.
            differs = (held[::-1, :4] != held[-1, :4]).any(axis=1)
            if not differs.any():
                continue
            last = len(held) - np.argmax(differs)
            yield from emit(held[:last])
            held = held[last:]
        if held is not None:
            yield from emit(held)

    def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = run_links(table[:, :4], table[:, 4:], distance)
        if len(left):
            pairs = np.concatenate([table[left, 4:], table[right, 4:]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=names)

    keys = ["mask", "key", "a", "b"]
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(partitions, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
        .distinct()
    )


def class_links(classes: DataFrame, lanes: list[str], distance: int) -> DataFrame:
    """Links between distinct fingerprints by block keys that suit their number."""
    return links(classes, lanes, pigeonhole_masks(LANE * len(lanes), distance, classes.count()), distance)


def hex_of(lanes: list[str], prefix: str = "") -> Column:
    """The fingerprint as hex digits, the highest lane first."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(c)), LANE // 4, "0")) for c in reversed(lanes)])


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    shingle: int = 4,
    bits: int = 64,
    distance: int = 4,
) -> DataFrame:
    """``id``, ``mark``, ``fingerprint``, ``root`` and ``component_id`` of every row.

    Fingerprints link at ``distance`` or fewer differing bits; the component's
    root is its least fingerprint, its id the least id reachable through links. No link is missed.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows get equal rows. A null id is kept and never names a component unless all
    of its ids are null. An empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    lanes = lane_names(bits)
    prints = keep_table(fingerprints(docs, text, id_column, shingle, bits))
    classes = keep_table(prints.groupBy(*lanes).agg(F.min("id").alias("least")))
    found = class_links(classes, lanes, distance)
    ends = [[f"{side}{i}" for i in range(len(lanes))] for side in "uv"]
    roots = components(found.select(hex_of(ends[0]).alias("u"), hex_of(ends[1]).alias("v")))
    named = classes.select(hex_of(lanes).alias("fingerprint"), "least").join(
        roots.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left"
    )
    # Unlinked classes name themselves; only linked ones are grouped.
    alone = named.filter("root is null").select(
        "fingerprint", F.col("fingerprint").alias("root"), F.col("least").alias("component_id")
    )
    together = named.filter("root is not null")
    least = together.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = together.join(least, "root").select("fingerprint", "root", "component_id")
    return (
        prints.select("id", "mark", hex_of(lanes).alias("fingerprint"))
        .join(alone.union(grouped), "fingerprint")
        .select("id", "mark", "fingerprint", "root", "component_id")
    )


def fingerprint_pairs(prints: DataFrame, lanes: list[str], distance: int) -> DataFrame:
    """Pairs ``u``, ``v`` of texts (by their hash, the lesser first) whose fingerprints are equal or linked.

    A text is paired with the first one of its fingerprint. The first one itself is paired with the
    nearest lesser and the nearest greater one among its links, so there are at most two pairs a text.
    """
    texts = keep_table(prints.select("mark", *lanes).distinct())
    classes = keep_table(texts.groupBy(*lanes).agg(F.min("mark").alias("first")))
    equal = texts.join(classes, lanes).filter("mark != first").select(F.col("first").alias("u"), F.col("mark").alias("v"))
    found = class_links(classes, lanes, distance)
    for side in "uv":
        ends = [f"{side}{i}" for i in range(len(lanes))]
        named = classes.select(*[F.col(c).alias(e) for c, e in zip(lanes, ends)], F.col("first").alias(side))
        found = found.join(named, ends)
    apart = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(len(lanes))), F.lit(0))
    found = keep_table(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), apart.alias("apart")))
    lesser = found.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v")
    greater = found.groupBy("u").agg(F.min_by("v", F.struct("apart", "v")).alias("v"))
    return equal.union(lesser.union(greater).distinct())


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; one 0 for a text without words."""
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(1, np.int64)


def parity(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """A bit is 1 if an odd number of the shingles falls on it.

    A shingle that only one of two sets has flips one bit, so fingerprints differ in no more
    bits than the sets differ in shingles.
    """
    bits = np.bincount((hashes.view(np.uint64) >> np.uint64(7)).astype(np.int64) % (LANE * lanes), minlength=LANE * lanes)
    return np.packbits((bits & 1).astype(bool), bitorder="little").view(np.int64)


def near_sets(n_u: np.ndarray, n_v: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` shingles or more can have the similarity."""
    sizes = np.minimum(n_u, n_v) >= np.maximum(n_u, n_v) * similarity - 1e-6
    return sizes & (apart * (1 + similarity) <= (n_u + n_v) * (1 - similarity) + 1e-6)


def common_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, their ranks by that number, and into how
    many parts the postings of one are dealt.

    They only say which shingles are looked at last and which are expected to be frequent: any
    order and any parts give the same pairs.
    """
    share = min(SAMPLE_SHARE, max(1, docs.count() // SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(body.as_py(), size))], names=["key"])

    body = text_or_empty(text)
    sample = docs.select(body.alias("body")).filter(F.pmod(F.xxhash64("body"), F.lit(share)) == 0)
    counted = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    rows = counted.orderBy(F.desc("n"), "key").limit(COMMON).collect()  # a bounded list
    keys = np.array([r["key"] for r in rows], np.int64)
    ranks = np.arange(len(rows), 0, -1)
    parts = np.array([r["n"] * share // HEAVY for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], ranks[order], parts[order]


def rare_first(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    if not len(common):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, ranks[at], 0)))]


def postings(docs: DataFrame, text: str, size: int, similarity: float) -> DataFrame:
    """``key``, ``part``, ``cls``, ``n``, ``p``: the shingles under which a text is listed, its hash, its set's size
    and, of a small set, a parity fingerprint.

    Sets of a similarity have that share of the larger set in common. So if a set
    leaves out less than that share of its shingles at the end of one common
    order, both rests still meet: the others are its prefix. A task lists each
    text once, so copies cost no more postings than there are tasks. A frequent
    shingle's texts are dealt over several parts by their hash; part 0 is that of
    all others.
    """
    common, ranks, parts = common_shingles(docs, text, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for mark, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if mark in seen:
                    continue
                seen.add(mark)
                hashes = shingle_set(body.as_py(), size)
                n = len(hashes)
                prefix = rare_first(hashes, common, ranks)[: n - math.ceil(similarity * n - 1e-9) + 1]
                part = np.zeros(len(prefix), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, prefix), len(common) - 1)
                    wide = np.where(common[at] == prefix, parts[at], 0)
                    part = np.where(wide > 1, mark % np.maximum(wide, 1) + 1, 0)
                short = int(parity(hashes, 1)[0]) if n <= PARITY_SET else 0
                columns = [prefix, part, *(np.full(len(prefix), v) for v in (mark, n, short))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "part", "cls", "n", "p"])

    body = text_or_empty(text)
    return docs.select(F.xxhash64(body).alias("mark"), body.alias("body")).mapInArrow(
        run, "key long, part long, cls long, n long, p long"
    )


def shared_postings(listed: DataFrame, similarity: float) -> DataFrame:
    """Postings under keys that two or more texts have: ``key``, ``cls``, ``n``, the first text of the key's
    part in ``cls0``, ``n0``, and in ``near`` (0 or 1) whether it may be similar. Keys of several parts are
    all taken to be shared."""
    names = ["key", "cls", "n", "cls0", "n0", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row waits for the next batch, with the first row of its key and whether it is that row.
        held, first, follows = np.empty((0, 5), np.int64), None, False

        def emit(rows: np.ndarray, firsts: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
            rows, firsts = rows[chosen], firsts[chosen]
            small = (rows[:, 3] <= PARITY_SET) & (firsts[:, 3] <= PARITY_SET)
            apart = np.where(small, differing(rows[:, 4:], firsts[:, 4:]), 0)
            near = near_sets(rows[:, 3], firsts[:, 3], apart, similarity).astype(np.int64)
            out = np.concatenate([rows[:, [0, 2, 3]], firsts[:, 2:4], near[:, None]], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = np.concatenate([held, rows])
            rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
            same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            before = np.r_[follows, same]
            starts = np.maximum.accumulate(np.where(before, 0, np.arange(len(rows))))
            firsts = rows[starts]
            if follows:
                firsts[starts == 0] = first
            chosen = (before | np.r_[same, False] | (rows[:, 1] > 0))[:-1]
            if chosen.any():
                yield emit(rows[:-1], firsts[:-1], chosen)
            held, first, follows = rows[-1:], firsts[-1], bool(before[-1])
        if follows or len(held) and held[0, 1] > 0:
            yield emit(held, first[None, :], np.array([True]))

    partitions = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        listed.repartition(partitions, "key", "part")
        .sortWithinPartitions("key", "part", "cls")
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
    )


def may_reach(similarity: float, n_u: str, n_v: str, met: Column) -> Column:
    """Whether sets of these sizes that share ``met`` prefix shingles can have the similarity.

    All shared shingles of the set whose prefix ends first lie in both prefixes or
    after its own.
    """
    rest = F.ceil(F.greatest(n_u, n_v) * similarity + 1e-9)
    near = F.least(n_u, n_v) >= F.greatest(n_u, n_v) * similarity - 1e-6
    return near & ((met + rest) * (1 + similarity) >= (F.col(n_u) + F.col(n_v)) * similarity - 1e-6)


def similar_pairs(
    pairs: DataFrame, least: DataFrame, docs: DataFrame, text: str, id_column: str, size: int, similarity: float
) -> DataFrame:
    """The pairs ``u``, ``v`` of texts whose shingle sets have the similarity, from the texts themselves.

    Texts travel, not sets, as they compress. The texts to be compared with one ``u`` go to
    one place, ``LEAVES`` of them at a time, so ``u`` itself travels once for so many.
    ``least`` names the row, ``id`` and ``mark``, where a text is read.
    """
    wide = keep_sized(
        pairs.groupBy(F.col("u").alias("centre")).agg(F.count("*").alias("pairs")).filter(F.col("pairs") > LEAVES)
    )
    chunk = F.coalesce(F.pmod(F.xxhash64("v"), F.ceil(F.col("pairs") / LEAVES)), F.lit(0)).cast("int")
    dealt = pairs.join(wide, F.col("u") == F.col("centre"), "left").select("u", chunk.alias("chunk"), "v")
    heads = dealt.select("u", "chunk", F.lit(0).alias("role"), F.col("u").alias("wanted")).distinct()
    wanted = heads.union(dealt.select("u", "chunk", F.lit(1).alias("role"), F.col("v").alias("wanted")))
    wanted = keep_sized(
        wanted.join(least.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")), F.col("wanted") == F.col("_mark"))
        .drop("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, last = None, None, None
        for batch in batches:
            found = []
            for i, (u, chunk, role, mark) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if (u, chunk, role, mark) == last:
                    continue
                last = (u, chunk, role, mark)
                shingles = shingle_set(batch.column(4)[i].as_py(), size)
                if role == 0:
                    at, centre = (u, chunk), shingles
                elif at == (u, chunk):
                    both = len(np.intersect1d(centre, shingles, assume_unique=True))
                    if both * (1 + similarity) >= (len(centre) + len(shingles)) * similarity - 1e-6:
                        found.append((u, mark))
            if found:
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    body = text_or_empty(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    read = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        read.select("u", "chunk", "role", "mark", "body")
        .repartition(partitions, "u", "chunk")
        .sortWithinPartitions("u", "chunk", "role", "mark")
        .mapInArrow(run, "u long, v long")
    )


def unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` of texts that are not in one component yet."""
    roots = keep_sized(roots)
    for side in "uv":
        known = roots.select(F.col("vertex").alias(f"vertex_{side}"), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(known, F.col(side) == F.col(f"vertex_{side}"), "left")
    return pairs.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def similar_texts(
    near: DataFrame,
    listed: DataFrame,
    least: DataFrame,
    docs: DataFrame,
    text: str,
    id_column: str,
    size: int,
    similarity: float,
) -> DataFrame:
    """``vertex`` and ``root`` of every text (by its hash) that is similar to another one, by links of exact similarity.

    First the pairs ``near`` by their SimHash fingerprints are compared. Of what they leave apart
    each text is compared with one that is the first of most of its keys, which
    joins most of a group in as many comparisons as it has texts. Then all pairs that are not
    joined yet, share enough of their prefixes and have near parity fingerprints are compared.
    """
    judge = lambda pairs: similar_pairs(pairs, least, docs, text, id_column, size, similarity)
    near = keep_table(near)
    close = keep_table(judge(near))
    shared = keep_table(shared_postings(listed, similarity))
    stars = shared.filter("near = 1 and cls != cls0").groupBy(F.col("cls0").alias("u"), F.col("cls").alias("v"), "n", "n0")
    stars = stars.agg(F.count("*").alias("met")).filter(may_reach(similarity, "n", "n0", F.col("met")))
    # The one that shares most: as many comparisons as texts, however many firsts a large group has.
    stars = stars.groupBy("v").agg(F.max_by("u", F.struct("met", "u")).alias("u")).select("u", "v")
    stars = unjoined(stars, keep_table(components(close)))
    stars = keep_table(stars.join(near, ["u", "v"], "left_anti"))
    found = keep_table(close.union(judge(stars)))
    roots = keep_table(components(found))
    placed = shared.join(keep_sized(roots), F.col("cls") == F.col("vertex"), "left").select(
        "key", "cls", "n", F.coalesce("root", "cls").alias("root")
    )
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    placed = keep_table(placed.join(mixed, "key", "left_semi"))
    prints = parities(placed.select("cls").distinct(), least, docs, text, id_column, size)
    pairs = meeting_pairs(placed, prints, similarity)
    pairs = pairs.filter(may_reach(similarity, "n_u", "n_v", F.col("met"))).select("u", "v")
    pairs = keep_table(pairs.join(near.union(stars), ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return roots
    return components(found.union(judge(pairs)))


def parities(
    wanted: DataFrame, least: DataFrame, docs: DataFrame, text: str, id_column: str, size: int
) -> DataFrame:
    """``of`` and the words ``p0``.. of the parity fingerprint of every wanted text."""
    chosen = least.join(wanted, F.col("mark") == F.col("cls"), "left_semi")
    chosen = keep_sized(chosen.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")))
    names = [f"p{i}" for i in range(PARITY_LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.empty((batch.num_rows, PARITY_LANES), np.int64)
            for i, body in enumerate(batch.column(1)):
                prints[i] = parity(shingle_set(body.as_py(), size), PARITY_LANES)
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["of", *names])

    body = text_or_empty(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("of"), body.alias("body"))
    met = rows.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_mark")), "left_semi")
    found = met.select("of", "body").mapInArrow(run, "of long, " + ", ".join(f"{c} long" for c in names))
    return keep_table(found.dropDuplicates(["of"]))


def meeting_pairs(placed: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``u``, ``v`` of texts of different roots under one key whose fingerprints may be those of similar
    sets, with ``n_u``, ``n_v`` and the number ``met`` of keys that they share.

    The texts of a key meet in a sorted stream and are compared there, so pairs of unlike
    texts are never rows. A key of more than ``BUCKET`` texts is cut into chunks that are
    compared two by two.
    """
    names = ["u", "n_u", "v", "n_v"]
    lanes = [c for c in prints.columns if c != "of"]
    crowded = keep_sized(
        placed.groupBy(F.col("key").alias("of_key")).agg(F.count("*").alias("rows")).filter(F.col("rows") > BUCKET)
        .select("of_key", F.ceil(F.col("rows") / BUCKET).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("cls", F.lit("chunk")), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))
    dealt = (
        placed.join(crowded, F.col("key") == F.col("of_key"), "left")
        .withColumn("chunk", F.coalesce(chunk, F.lit(0)))
        .withColumn("other", F.explode(others))
        .select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "cls", "n", "root")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(table):
                continue
            held = table if held is None else np.concatenate([held, table])
            differs = (held[::-1, :3] != held[-1, :3]).any(axis=1)
            if not differs.any():
                continue
            last = len(held) - np.argmax(differs)
            yield from emit(held[:last])
            held = held[last:]
        if held is not None:
            yield from emit(held)

    def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Row against row, one step further apart at a time, as long as some key goes on."""
        starts = np.flatnonzero(np.r_[True, (table[1:, :3] != table[:-1, :3]).any(axis=1)])
        ends = np.repeat(np.r_[starts[1:], len(table)], np.diff(np.r_[starts, len(table)]))
        rows, step = np.arange(len(table)), 1
        while len(rows := rows[rows + step < ends[rows]]):
            one, two = table[rows], table[rows + step]
            met = (one[:, 5] != two[:, 5]) & (one[:, 3] != two[:, 3])
            met[met] = near_sets(one[met, 4], two[met, 4], differing(one[met, 6:], two[met, 6:]), similarity)
            if met.any():
                one, two = one[met], two[met]
                swap = (one[:, 3] > two[:, 3])[:, None]
                pairs = np.concatenate(
                    [np.where(swap, two[:, 3:5], one[:, 3:5]), np.where(swap, one[:, 3:5], two[:, 3:5])], axis=1
                )
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=names)
            step += 1

    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        dealt.join(prints, F.col("cls") == F.col("of")).select("key", "a", "b", "cls", "n", "root", *lanes)
        .repartition(partitions, "key", "a", "b")
        .sortWithinPartitions("key", "a", "b")
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
    )
    # Two chunks hold the pairs within one of them as often as there are chunks; more is only
    # counted as met in more keys, which lets a pair through to the comparison.
    return found.groupBy(*names).agg(F.count("*").alias("met"))


def drop_near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    shingle: int = 5,
    similarity: float = 0.8,
    bits: int = 64,
    distance: int = 4,
) -> DataFrame:
    """One row of each near-duplicate group, with all columns.

    Texts are near duplicates if the sets of their word shingles have a Jaccard
    similarity of ``similarity`` or more; groups are the components of such links.
    SimHash fingerprints of ``bits`` bits at ``distance`` or fewer differing ones find near
    texts first, a prefix join the similar ones further apart, so the two options change
    the work and not the rows. No pair is missed and every link is verified on the sets. The row with the
    least id of a group stays, of equal ids the one with the least text hash, of
    repeated rows one; rows with null ids come last. Texts without words are equal.
    """
    prints = keep_table(fingerprints(docs, text, id_column, shingle, bits))
    rows = prints.select("id", "mark")
    least = rows.groupBy("mark").agg(F.min("id").alias("id"))
    near = fingerprint_pairs(prints, lane_names(bits), distance)
    listed = postings(docs, text, shingle, similarity)
    roots = similar_texts(near, listed, least, docs, text, id_column, shingle, similarity)
    judged = rows.join(roots, F.col("mark") == F.col("vertex"), "left").select(
        "id", "mark", F.coalesce("root", "mark").alias("root")
    )
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    per_row = judged.groupBy(F.col("root").alias("group"), "id", "mark").agg(F.count("*").alias("n"))
    # Groups without a second row need no decision.
    winners = per_row.groupBy("group").agg(F.min(order).alias("w"), F.sum("n").alias("size")).filter("size > 1")
    lost = (
        per_row.join(winners.select("group", "w"), "group")
        .select("id", "mark", "n", (order == F.col("w")).alias("stays"))
        .filter("not stays or n > 1")
        .select(F.col("id").alias("_lost_id"), F.col("mark").alias("_lost_mark"), F.col("stays").alias("_stays"))
    )
    lost = keep_sized(lost)
    packed = docs.select(
        F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_mark")
    )
    joined = packed.join(
        lost, F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_mark") == F.col("_lost_mark")), "left"
    )
    kept = joined.filter("_stays is null").select("_row.*")
    if lost.filter("_stays").isEmpty():
        return kept
    # Rows that repeat a staying row: one of each is kept.
    repeated = joined.filter("_stays").dropDuplicates(["_id", "_mark"]).select("_row.*")
    return kept.union(repeated)
