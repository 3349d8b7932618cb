from __future__ import annotations

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, turns string"


def turns(spark, rows):
    return chat.conversations(spark.createDataFrame([(*r, "k", "t") for r in rows], SCHEMA), "conv_id")


CHOSEN = [
    (1, 0, "system", "Be kind"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello \U0001f600"), (1, 3, "user", "More"), (1, 4, "assistant", "Sure"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "only chosen"), (4, 0, None, None), (4, 0, None, None),
    (None, 0, "user", "no key"), (5, None, "user", "no turn"),
]
REJECTED = [
    (1, 0, "system", "Be kind"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Go away"), (2, 0, "user", "same"), (2, 1, "assistant", "same"),
    (4, 0, "user", ""), (6, 0, "assistant", "only rejected"),
]


def test_prompt_completions_and_spans(spark):
    got = {r.key: r for r in chat.format_preferences(turns(spark, CHOSEN), turns(spark, REJECTED)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6]
    one = got[1]
    assert one.n_common == 2 and one.prompt == "<|system|>\nBe kind<|end|>\n<|user|>\nHi<|end|>\n"
    learned = [one.chosen[int(a) : int(b)] for a, b in (s.split(":") for s in one.chosen_learned.split(","))]
    assert learned == ["Hello \U0001f600<|end|>", "Sure<|end|>"]
    assert one.rejected == "<|assistant|>\nGo away<|end|>\n" and one.rejected_learned == "14:28"
    assert (got[2].chosen, got[2].rejected, got[2].chosen_learned) == ("", "", "")
    assert got[2].n_common == 2 and got[3].prompt == "" and got[3].rejected == "" and got[3].chosen_learned == ""
    assert got[4].n_common == 1 and got[6].chosen == "" and got[6].rejected_learned == "14:34"


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(1500)]
    other = rows[:100] + [(1, 100, "user", "turns off")]
    got = chat.format_preferences(turns(spark, rows), turns(spark, other)).first()
    spans = [s.split(":") for s in got.chosen_learned.split(",")]
    assert got.n_common == 100 and [got.chosen[int(a) : int(b)] for a, b in spans] == [f"text {i}<|end|>" for i in range(101, 1500, 2)]


def test_stale_replies(spark):
    chosen, rejected = chat.stale_reply_pairs(turns(spark, CHOSEN))
    sides = {r.key: [t["text"] for t in r.turns] for r in rejected.collect()}
    assert sides == {1: ["Be kind", "Hi", "Hello \U0001f600", "More", "Hello \U0001f600"], 2: ["same", "same"]}
    assert {r.key for r in chosen.collect()} == {1, 2}


def test_empty_tables(spark):
    none = turns(spark, [])
    assert chat.format_preferences(none, none).count() == 0
    assert [c.count() for c in chat.stale_reply_pairs(none)] == [0, 0]
