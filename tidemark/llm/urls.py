"""URL filter: a blocked Bloom filter in front of an exact hash join.

A list of rules names a host, a path prefix and a verdict. A rule's canonical
URL is its lower-cased host followed by its path. The filter is a table of
blocks of 256 bits; a URL's candidate keys (its host and parent domains, each
with every prefix of the path that has the length of some listed path) look up
one block each, and only those whose bits are all set go on to the hash join
with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, keep_sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is this many 64-bit words; each key sets two bits in every word.
BLOCK_WORDS = 4


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(url_rest(url), r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row per listed canonical URL: ``host``, ``path``, ``rule``, ``verdict``.

    Hosts are lower-cased; rules without a host are dropped; a null path counts
    as empty; of rules that differ only in the verdict, ``block`` holds.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    return (
        rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host is not null and host != '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
    )


def key_bits(key: Column) -> list[Column]:
    """The words of a key's mask: two bits of each, from one 64-bit hash."""
    bits = F.xxhash64(key, F.lit("bits"))

    def one(i: int) -> Column:
        return F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")
        )

    return [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(BLOCK_WORDS)]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks).cast("long"))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: one row per block with a set bit, its words ``w0``..``w3``."""
    masks = keys.select(
        block_of(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(key_bits(F.col(key)))]
    )
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])


def possible_hits(probes: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key has all its bits set in its block of the filter."""
    joined = probes.withColumn("block", block_of(F.col(key), blocks)).join(bloom, "block")
    for i, mask in enumerate(key_bits(F.col(key))):
        joined = joined.filter(F.col(f"w{i}").bitwiseAND(mask) == mask)
    return joined.select(*probes.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    bits_per_key: int = 16,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Host, path, the rule that holds and the verdict of every URL.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, of equally long ones that with the longer host. URLs
    without a rule get ``default``. A null URL, or one without ``://``, has an
    empty host and path and gets the default; rows are never dropped, repeated
    rows stay repeated, and of the columns only ``keep`` are read and returned.
    An empty table gives an empty result, an empty list the default everywhere.

    Distinct (host, path beginning) pairs are judged, so a host that holds a
    third of all pages costs one probe per path beginning. Both the filter and
    the list are broadcast only when their measured size allows it.
    """
    listed = keep_sized(canonical_rules(rules), broadcast_bytes)
    # Distinct path lengths and label counts: at most as many as a URL has characters.
    shape = listed.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
    ).first()
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shape["n"]:
        nothing = F.lit(None).cast("string")
        return rows.select(*keep, "host", "path", nothing.alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, -(-shape["n"] * bits_per_key // (64 * BLOCK_WORDS)))
    bloom = keep_sized(bloom_blocks(listed, "rule", blocks), broadcast_bytes)

    longest = max(shape["lengths"])
    start = F.substring("path", 1, longest)
    shapes = rows.select("host", start.alias("start")).distinct()
    names = F.split("host", r"\.")
    hosts = F.array_compact(
        F.array(*[F.when(F.size(names) >= n, F.substring_index("host", ".", -n)) for n in shape["labels"]])
    )
    starts = F.array_compact(
        F.array(*[F.when(F.length("start") >= n, F.substring("start", 1, n)) for n in shape["lengths"]])
    )
    probes = (
        shapes.select("host", "start", F.explode(hosts).alias("parent"), starts.alias("starts"))
        .select("host", "start", "parent", F.explode("starts").alias("prefix"))
        .withColumn("probe", F.concat("parent", "prefix"))
    )
    passed = possible_hits(probes, "probe", bloom, blocks)
    exact = listed.select(F.col("host").alias("parent"), F.col("path").alias("prefix"), "rule", "verdict")
    best = F.struct(F.length("rule").alias("a"), F.length("parent").alias("b"), "rule", "verdict")
    found = (
        passed.join(exact.hint("shuffle_hash"), ["parent", "prefix"])
        .groupBy("host", "start")
        .agg(F.max(best).alias("best"))
        .select("host", "start", "best.rule", "best.verdict")
    )
    found = keep_sized(found, broadcast_bytes)
    return (
        rows.withColumn("start", start)
        .join(found, ["host", "start"], "left")
        .select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
