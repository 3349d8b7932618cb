"""Quality rules as a cascade ordered by what each rule rejects per second.

A rule is a condition on a text that rejects it. Each rule's cost and selectivity
are estimated on a sample: its seconds a row, over those of a rule that does nothing,
and the share that it rejects. The cascade asks the rules in order of rejected share
per second and stops at the first that rejects, inside one ``CASE`` expression, so a
costly rule is worked out only for texts that are still standing. The order changes the
cost only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, words_of
from tidemark.session import keep_table

#: Words in a window that must not repeat.
WINDOW = 8
#: Times that a rule is timed on the sample, after one run that compiles it.
RUNS = 3


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the rejecting condition from the text column."""

    name: str
    rejects: Callable[[Column], Column]


def n_symbols(text: Column) -> Column:
    """Characters of ``#*$%&|<>``."""
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return F.aggregate(
        F.transform(F.array(lines), lambda v: F.size(v) - F.size(F.array_distinct(v))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, whatever ``use`` does with it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A hash of every window of ``size`` words; empty if there are fewer."""

    def windows(hashes: Column) -> Column:
        none = F.array().cast("array<bigint>")
        starts = F.sequence(F.lit(1), F.size(hashes) - (size - 1))
        return F.when(F.size(hashes) < size, none).otherwise(
            F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, size)))
        )

    return bound_once(F.transform(words, lambda w: F.xxhash64(w)), windows)


def covered_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words inside windows whose hash occurs twice or more in the array.

    Most texts repeat no window; they are told by the number of distinct hashes.
    For the others, windows are sorted by hash, neighbours compared, and the
    repeated windows' positions give the words that they cover.
    """

    def positions(pairs: Column) -> Column:
        def repeated(p: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            twice = F.coalesce(before["h"] == p["h"], F.lit(False)) | F.coalesce(after["h"] == p["h"], F.lit(False))
            return F.when(twice, p["at"])

        return F.sort_array(F.array_compact(F.transform(pairs, repeated)))

    def cover(starts: Column) -> Column:
        reach = F.transform(
            starts, lambda s, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - s, F.lit(size)))
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(values: Column) -> Column:
        pairs = F.sort_array(F.transform(values, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(values) == F.size(F.array_distinct(values)), F.lit(0).cast("long")).otherwise(
            bound_once(bound_once(pairs, positions), cover)
        )

    return bound_once(hashes, count)


def n_repeat_words(text: Column) -> Column:
    return covered_words(window_hashes(words_of(text)))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def few_trigrams(text: Column) -> Column:
    """Whether under a quarter of the runs of three words are different ones."""
    windows = window_hashes(words_of(text), 3)
    return bound_once(windows, lambda w: 4 * F.size(F.array_distinct(w)) < F.size(w))


# Generous limits: ordinary prose of any language is far from all of them.
RULES = (
    Rule("few_words", lambda t: n_words(t) < 20),
    Rule("repeated_windows", lambda t: 100 * n_repeat_words(t) > 30 * n_words(t)),
    Rule("symbols", lambda t: 2 * n_symbols(t) > n_words(t)),
    Rule("duplicate_lines", lambda t: 2 * n_dup_lines(t) > F.size(F.split(t, "\n", -1))),
    Rule("long_words", lambda t: word_chars(words_of(t)) > 25 * n_words(t)),
    Rule("no_letters", lambda t: ~F.regexp_like(t, F.lit(r"\p{L}"))),
    Rule("few_trigrams", few_trigrams),
)


def measure(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Exact measures of every whole text, and the text as ``body``; a null text counts as empty."""
    body = text_or_empty(text)
    listed = docs.select(F.col(id_column), body.alias("body")).withColumn("words", words_of(F.col("body")))
    return listed.select(
        id_column,
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("words")).alias("word_chars"),
        n_symbols(F.col("body")).alias("n_symbols"),
        n_dup_lines(F.col("body")).alias("n_dup_lines"),
        covered_words(window_hashes(F.col("words"))).alias("n_repeat_words"),
        F.size(F.split("body", "\n", -1)).alias("n_lines"),
        F.regexp_like("body", F.lit(r"\p{L}")).alias("has_letter"),
        "body",
    )


def timed(sample: DataFrame, rejects: Column) -> tuple[float, float]:
    """Least seconds of ``RUNS`` passes over the sample and the share that it rejects."""
    job = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double")))
    share, best = job.first()[0] or 0.0, float("inf")
    for _ in range(RUNS):
        began = time.perf_counter()
        job.collect()
        best = min(best, time.perf_counter() - began)
    return best, share


def estimate(sample: DataFrame, rules: Sequence[Rule], text: Column) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, rejected share) of each rule on the sample's rows.

    What a pass costs without any rule, its start and the scan, is taken off.
    """
    rows = max(sample.count(), 1)
    idle, _ = timed(sample, F.length(text) < 0)
    found = []
    for rule in rules:
        seconds, share = timed(sample, rule.rejects(text))
        found.append((rule, max(seconds - idle, 1e-6) / rows, share))
    return found


def ordered_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    share: float = 0.01,
    seed: int = 7,
    prepare: Callable[[DataFrame], DataFrame] = lambda sample: sample,
) -> list[Rule]:
    """Rules by rejected share per second on a sample, the best first.

    The sample takes ``share`` of the rows at random, by Spark's seeded Bernoulli
    sampling; ``prepare`` adds what the rules read (``text`` among it). It is written
    once and read for each rule.
    """
    sample = keep_table(prepare(docs.sample(share, seed)))
    scored = estimate(sample, rules, text_or_empty(text))
    return [r for r, cost, rejected in sorted(scored, key=lambda x: -x[2] / x[1])]


def asked_rows(verdicts: DataFrame, rules: Sequence[Rule], verdict: str = "verdict") -> DataFrame:
    """``rule``, ``asked`` and ``rejected``: how many rows each rule of a cascade was worked out for.

    ``verdicts`` holds the name of the rule that rejected each row, or null.
    """
    counts = [F.count_if(F.col(verdict) == r.name).alias(f"_{i}") for i, r in enumerate(rules)]
    totals = verdicts.agg(F.count(F.lit(1)).alias("_all"), *counts)
    rows, left = [], F.col("_all")
    for i, rule in enumerate(rules):
        rows.append(F.struct(F.lit(rule.name).alias("rule"), left.alias("asked"), F.col(f"_{i}").alias("rejected")))
        left = left - F.col(f"_{i}")
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cascade(rules: Sequence[Rule], text: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def filter_quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", share: float = 0.01
) -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    A null text counts as empty. Rows are judged one by one, so repeated rows
    share their fate; an empty table stays empty; other columns do not matter.
    """
    ordered = ordered_rules(docs.select(text), rules, text, share)
    packed = docs.select(F.struct("*").alias("_row"))
    body = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    return packed.filter(cascade(ordered, body).isNull()).select("_row.*")
