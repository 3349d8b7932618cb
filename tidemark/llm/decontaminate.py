"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over ``SPAN`` successive tokens that ignores some of them,
so a substituted token spoils only the seeds that look at it. Test items and
documents are hashed under every mask at every position, the hashes are joined,
and around each hit the tokens are compared one by one: a hit counts if some run
of ``overlap`` tokens differs from the item in ``substitutions`` at most. The masks
are chosen so that every choice of substituted tokens leaves a seed intact; items
of fewer than ``SPAN`` tokens have masks of their own length.

The test items are the bounded side. Their seeds fill a small bit filter that is
sent with the tasks, so documents are read once, nothing of their text is
shuffled, and only positions that pass leave the row, with the few token hashes
around them that the verification needs. Items come in blocks, one pass over the
documents each, so the filter stays bounded however many there are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_sized, text_or_empty
from tidemark.llm.quality import bound_once
from tidemark.session import keep_table

# The masks; a 1 looks at the token, a 0 ignores it. Each of the 78 pairs of
# positions in 13 tokens, and each position in 9 to 12, leaves some mask intact at some offset.
MASKS = ("001101111", "110111100", "111010011")
SPAN = 9
#: Tokens of a verified overlap, and how many of them may differ.
OVERLAP, SUBSTITUTIONS = 13, 2
# Blocks of scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han), where
# every letter is a token.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
PLAIN_TOKEN = r"[\p{L}\p{N}]+"
TOKEN = rf"[\p{{L}}\p{{N}}\p{{M}}&&[^{UNSPACED}]]+|[{UNSPACED}&&[\p{{L}}\p{{N}}]]\p{{M}}*"
#: Items of fewer tokens say too little to be looked for inside of a text.
LEAST = 5
#: Seeds of one pass over the documents, and bits of the filter for each.
SEEDS_PER_PASS = 1_000_000
BITS_PER_SEED = 64


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens; a text without such letters and marks takes the cheaper of two equal patterns."""
    plain, full = (F.regexp_extract_all(F.lower(text), F.lit(t), F.lit(0)) for t in (PLAIN_TOKEN, TOKEN))
    words = F.when(text.rlike(rf"[{UNSPACED}\p{{M}}]"), full).otherwise(plain)
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(length: int, overlap: int, substitutions: int) -> list[str]:
    """Masks over a whole item of ``length`` tokens; its substitutions leave one of them intact."""
    allowed = length * substitutions // overlap if length >= LEAST else 0
    ways = allowed + 2
    return ["".join("01"[i % ways not in gone] for i in range(length)) for gone in combinations(range(ways), allowed)]


def all_masks(items: DataFrame, text: str, overlap: int, substitutions: int) -> list[str]:
    """``MASKS``, and those of the lengths below ``SPAN`` that some item has."""
    length = F.size(token_hashes(text_or_empty(text)))
    found = items.select(length.alias("n")).filter((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect()
    return [*MASKS, *[m for n in sorted(r["n"] for r in found) for m in short_masks(n, overlap, substitutions)]]


def seed_hash(hashes: Column, at: Column, mask: str, number: int) -> Column:
    looked = [at + o for o, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(*[F.get(hashes, p) for p in looked], F.lit(number))


def positions(hashes: Column, span: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(hashes) < span, none).otherwise(F.sequence(F.lit(0), F.size(hashes) - span))


def around(hashes: Column, at: Column, reach: int) -> Column:
    """Token hashes from ``reach`` before a seed to ``reach`` after it, null outside the text."""
    offsets = F.array(*[F.lit(o) for o in range(-reach, SPAN + reach)])
    return F.transform(offsets, lambda o: F.when(at + o >= 0, F.get(hashes, at + o)))


def item_seeds(items: DataFrame, text: str, id_column: str, reach: int, masks: list[str]) -> DataFrame:
    """``seed``, ``item``, ``length``, ``item_at`` and ``item_around`` of every seed of every item."""

    def of_mask(hashes: Column, number: int) -> Column:
        span = len(masks[number])
        places = positions(hashes, span)
        if span < SPAN:  # a shorter mask is for items of its length
            places = F.filter(places, lambda _: F.size(hashes) == span)
        return F.transform(
            places,
            lambda p: F.struct(
                seed_hash(hashes, p, masks[number], number).alias("seed"),
                p.alias("item_at"),
                around(hashes, p, reach).alias("item_around"),
            ),
        )

    def all_seeds(hashes: Column) -> Column:
        return F.concat(*[of_mask(hashes, n) for n in range(len(masks))])

    hashed = items.select(F.col(id_column).alias("item"), token_hashes(text_or_empty(text)).alias("hashes"))
    listed = hashed.select(
        "item", F.size("hashes").alias("length"), F.explode(bound_once(F.col("hashes"), all_seeds)).alias("s")
    )
    return listed.select("item", "length", "s.*").distinct()


def filter_bits(seeds: DataFrame, words: int) -> Column:
    """The bit filter: three bits of one 64-bit word for every seed, as an array.

    It is a scalar subquery: a query works it out once and sends it with its tasks, and
    neither the plan's text nor the driver's program holds it.
    """
    x = F.col("seed")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), part(x, k).cast("int"))
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    filled = seeds.select(x.bitwiseAND(words - 1).alias("word"), mask.alias("mask"))
    every = seeds.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    merged = filled.union(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    # One row per word of the bounded filter.
    listed = keep_table(merged.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words")).select("words.mask"))
    return listed.scalar()


def part(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 40 + 6 * k).bitwiseAND(63)


def passing(hashes: Column, bits: Column, words: int, reach: int, masks: list[str]) -> Column:
    """Positions of a text whose seeds pass the filter, with the tokens around them."""

    def test(x: Column) -> Column:
        word = F.get(bits, x.bitwiseAND(words - 1).cast("int"))
        return reduce(lambda a, b: a & b, [F.getbit(word, part(x, k).cast("int")) == 1 for k in range(3)])

    def of_mask(number: int) -> Column:
        span = len(masks[number])
        places = positions(hashes, span)
        if span < LEAST:  # a scant item must be the whole text
            places = F.when(F.size(hashes) == span, places).otherwise(F.array().cast("array<int>"))
        seeds = F.transform(places, lambda p: seed_hash(hashes, p, masks[number], number))
        one = lambda x, p: F.struct(x.alias("seed"), p.alias("at"), (p + span).alias("until"))
        return F.array_compact(F.transform(seeds, lambda x, p: F.when(test(x), one(x, p))))

    found = F.concat(*[of_mask(n) for n in range(len(masks))])
    return F.transform(
        found,
        lambda s: F.struct(
            s["seed"].alias("seed"), s["at"].alias("at"), s["until"].alias("until"), around(hashes, s["at"], reach).alias("around")
        ),
    )


def overlaps(length: Column, left: Column, right: Column, overlap: int, substitutions: int) -> Column:
    """Whether a run of ``overlap`` aligned tokens differs in ``substitutions`` at most.

    For an item with fewer tokens the run is the whole item, and the substitutions
    allowed shrink in proportion.
    """
    run = F.least(length, F.lit(overlap))
    allowed = F.floor(run * substitutions / overlap).cast("int")
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))

    def any_run(equal: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(equal) - run + 1)
        return F.exists(
            starts,
            lambda s: F.aggregate(F.slice(equal, s, run), F.lit(0), lambda a, x: a + x) >= run - allowed,
        )

    return bound_once(same, any_run)


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    overlap: int = OVERLAP,
    substitutions: int = SUBSTITUTIONS,
    seeds_per_pass: int = SEEDS_PER_PASS,
) -> DataFrame:
    """``id``, ``mark``, ``item``, ``n_hits``, ``first_token``, ``last_token`` of every contaminated pair.

    One row per document and item with a verified hit: the number of verified seed
    positions and the span of document tokens that they lie in. Tokens are runs of
    letters, digits and combining marks, lower-cased, and single letters of scripts
    without spaces. Items of fewer than ``overlap`` tokens match as a whole, with
    substitutions in proportion; of fewer than ``LEAST`` tokens only where they are all
    of a text, without substitutions, as such words stand in many clean texts. Null texts have no tokens; null ids are kept. Repeated
    rows give one row; ``mark`` is a hash of the text that tells rows of one id
    apart. An empty table on either side gives an empty result; other columns are
    not read.
    """
    reach = overlap
    masks = all_masks(items, item_text, overlap, substitutions)
    seeds = keep_table(item_seeds(items, item_text, item_id, reach, masks))
    count = seeds.count()
    passes = max(1, -(-count // seeds_per_pass))
    found = None
    for number in range(passes):
        block = seeds.filter(F.pmod(F.xxhash64("seed"), F.lit(passes)) == number) if passes > 1 else seeds
        one = _pass(docs, block, text, id_column, min(count, seeds_per_pass), overlap, substitutions, masks)
        found = one if found is None else found.union(one)
    hits = found.groupBy("id", "mark", "item", "at").agg(F.max("until").alias("until"))
    return hits.groupBy("id", "mark", "item").agg(
        F.count("*").alias("n_hits"),
        F.min("at").cast("long").alias("first_token"),
        F.max("until").cast("long").alias("last_token"),
    )


def _pass(
    docs: DataFrame,
    seeds: DataFrame,
    text: str,
    id_column: str,
    count: int,
    overlap: int,
    substitutions: int,
    masks: list[str],
) -> DataFrame:
    words = 1
    while words * 64 < count * BITS_PER_SEED:
        words *= 2
    body = text_or_empty(text)
    rows = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(body).alias("mark"), token_hashes(body).alias("hashes"),
        filter_bits(seeds, words).alias("bits"),
    )
    near = rows.select(
        "id", "mark",
        F.explode(bound_once(F.col("hashes"), lambda h: passing(h, F.col("bits"), words, overlap, masks))).alias("s"),
    ).select("id", "mark", "s.*")
    # The seeds of a pass are bounded; their size is measured before they are sent.
    joined = near.join(keep_sized(seeds), "seed")
    sure = joined.filter(
        overlaps(F.col("length"), F.col("around"), F.col("item_around"), overlap, substitutions)
    )
    return sure.select("id", "mark", "item", "at", "until")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", **options
) -> DataFrame:
    """The rows without an overlap with any item, with all their columns."""
    found = find_overlaps(docs, items, text, id_column, **options)
    lost = keep_sized(found.select(F.col("id").alias("_lost_id"), F.col("mark").alias("_lost_mark")).distinct())
    packed = docs.select(
        F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_mark")
    )
    same = F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_mark") == F.col("_lost_mark"))
    return packed.join(lost, same, "left_anti").select("_row.*")
