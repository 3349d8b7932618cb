"""Preference pairs: one prompt and two completions with their loss masks.

The longest common beginning of the chosen and the rejected conversation, in whole
turns, is rendered once as the prompt. What follows it is rendered for each side
with the spans of characters that a loss should count: the assistant's words and
their end mark. Headers and other roles' turns are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import bound_once

#: A turn is rendered as the opening with its role, its text and the closing.
OPENING, CLOSING = ("<|", "|>\n"), "<|end|>\n"
LEARNED = "assistant"
TURN = "struct<turn:bigint,role:string,text:string>"


def conversations(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per key with the array ``turns``, ordered by turn number, role and text.

    Repeated rows of a turn count once; rows without a key or turn number are left
    out; a null role counts as ``user``, a null text as empty. A conversation is the
    unit that is rendered, so its turns meet in one row.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("user")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = turns.filter(F.col(key).isNotNull() & F.col(turn).isNotNull()).select(F.col(key).alias("key"), one.alias("turn"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("turn")).alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPENING[0]), turn["role"], F.lit(OPENING[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(CLOSING))), "")


def common_turns(left: Column, right: Column) -> Column:
    """Number of turns at the beginning with equal role and text."""
    same = F.zip_with(
        left, right, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    first = F.array_position(F.concat(same, F.array(F.lit(False))), False)
    return (first - 1).cast("int")


def learned_spans(turns: Column) -> Column:
    """``start:end`` of the learned characters of the rendered turns, joined by commas."""
    sizes = F.transform(turns, lambda t: F.length(header(t)) + F.length(t["text"]) + len(CLOSING))

    def spans(lengths: Column) -> Column:
        # Sums of blocks of turns keep a very long conversation from quadratic work.
        block = 64
        numbers = F.sequence(F.lit(0), (F.size(lengths) / block).cast("int"))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        blocks = F.transform(numbers, lambda b: total(F.slice(lengths, b * block + 1, block)))

        def one(before: Column) -> Column:
            def span(t: Column, i: Column) -> Column:
                at = (i / block).cast("int")
                end = F.get(before, at) + total(F.slice(lengths, at * block + 1, i % block + 1))
                start = end - F.length(t["text"]) - len(CLOSING)
                # The line break after the end mark is not learned.
                return F.when(
                    t["role"] == LEARNED, F.concat_ws(":", start.cast("string"), (end - 1).cast("string"))
                )

            return F.array_join(F.array_compact(F.transform(turns, span)), ",")

        return bound_once(
            bound_once(blocks, lambda b: F.transform(numbers, lambda n: total(F.slice(b, F.lit(1), n)))), one
        )

    return bound_once(sizes, spans)


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``key``, ``n_common``, ``prompt`` and each side's completion and learned spans.

    Both tables have ``key`` and ``turns`` as ``conversations`` makes them; a key that
    is missing on one side counts as an empty conversation there. Equal conversations
    give empty completions. Spans count characters of the completion, the end
    exclusive. An empty table on both sides gives an empty result.
    """
    none = F.array().cast(f"array<{TURN}>")
    sides = chosen.select("key", F.col("turns").alias("c")).join(
        rejected.select("key", F.col("turns").alias("r")), "key", "full"
    )
    sides = sides.select("key", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    sides = sides.withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.size(side) + 1)
    cut = sides.select(
        "key", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"),
        rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"),
    )
    return cut.select(
        "key",
        "n_common",
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        learned_spans(F.col("c")).alias("chosen_learned"),
        rendered(F.col("r")).alias("rejected"),
        learned_spans(F.col("r")).alias("rejected_learned"),
    )


def stale_reply_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones (``key``, ``turns``).

    Chosen is the conversation up to its last assistant turn; in the rejected one that
    turn repeats the first assistant turn's text or, if it is the only one, the turn
    before it. Conversations without an assistant turn give no pair.
    """
    replies = F.filter("turns", lambda t: t["role"] == LEARNED)
    with_reply = turns.withColumn("replies", replies).filter(F.size("replies") > 0)
    last = F.element_at("replies", -1)
    up_to = F.filter("turns", lambda t: (t["turn"] < last["turn"]) | (t == last))
    sides = with_reply.select("key", up_to.alias("turns"), "replies")
    final = F.element_at("turns", -1)
    size = F.size("turns")
    before = F.when(size > 1, F.get(F.col("turns"), size - 2)["text"]).otherwise("")
    stale = F.when(F.size("replies") > 1, F.get(F.col("replies"), F.lit(0))["text"]).otherwise(before)
    turn = F.struct(final["turn"].alias("turn"), final["role"].alias("role"), stale.alias("text"))
    swapped = F.concat(F.slice("turns", F.lit(1), size - 1), F.array(turn))
    return sides.select("key", "turns"), sides.select("key", swapped.alias("turns"))
