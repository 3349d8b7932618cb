from __future__ import annotations

import re

from pyspark.sql import functions as F

from llm_rows import EDGE, make

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    out = []
    for d, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        seen: dict = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append(
            (d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        )
    return sorted(out, key=str)


def test_measures_match_brute_force(spark, prose):
    rows = prose + EDGE + [(900, "a b\n\na b\n \na b\n#x <y>", None, None), (901, "r " * 50 + "tail", None, None)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.measure(make(spark, rows)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_order_follows_rejection_per_second(spark, monkeypatch):
    rules = [quality.Rule(n, lambda t, s=s: F.length(t) < s) for n, s in (("none", 0), ("some", 3), ("all", 99))]
    df = spark.createDataFrame([("a",), ("abcd",), ("abcde",)], "text string")
    scored = quality.estimate(df, rules, F.col("text"))
    assert [round(s, 3) for _, _, s in scored] == [0.0, 0.333, 1.0] and all(c > 0 for _, c, _ in scored)
    # Costs of the idle pass, then of each rule; "all" costs 60 times what "some" does.
    passes = iter([(5.0, 0.0), (6.0, 0.0), (5.1, 0.333), (11.0, 1.0)])
    monkeypatch.setattr(quality, "timed", lambda *a: next(passes))
    costs = quality.estimate(df, rules, F.col("text"))
    assert [round(c * 3, 6) for _, c, _ in costs] == [1.0, 0.1, 6.0]
    monkeypatch.setattr(quality, "estimate", lambda *a: costs)
    assert [r.name for r in quality.ordered_rules(df, rules, share=1.0)] == ["some", "all", "none"]


def test_a_costly_rule_is_worked_out_for_survivors_only(spark):
    """The last rule fails the job on any row that an earlier one has rejected."""
    short = quality.Rule("short", lambda t: F.length(t) < 3)
    marked = quality.Rule("marked", lambda t: F.contains(t, F.lit("#")))
    costly = quality.Rule(
        "costly", lambda t: F.when(short.rejects(t) | marked.rejects(t), F.raise_error(F.lit("asked")).cast("boolean")).otherwise(F.length(t) > 8)
    )
    texts = ["a", "", "abc", "abc#", "abcdefghij", "abcdef", "#"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = [short, marked, costly]
    judged = df.select(quality.cascade(rules, F.col("text")).alias("verdict"))
    asked = {r.rule: (r.asked, r.rejected) for r in quality.asked_rows(judged, rules).collect()}
    assert asked == {"short": (7, 3), "marked": (4, 1), "costly": (3, 1)}


def test_few_trigrams(spark):
    texts = ["a b c " * 40, "one two", "", "a b c d e f g h", "x " * 30, " ".join(f"w{i}" for i in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(quality.few_trigrams(F.col("text"))).collect()]
    assert got == [True, False, False, False, True, False]


def test_any_order_keeps_the_same_rows(spark, prose):
    df = make(spark, prose + EDGE).withColumn("name", F.lit("clash"))
    orders = (quality.RULES, quality.RULES[::-1])
    kept = [
        {r.doc_id for r in df.filter(quality.cascade(o, F.coalesce("text", F.lit(""))).isNull()).collect()} for o in orders
    ]
    assert kept[0] == kept[1]
    filtered = quality.filter_quality(df, share=0.5)
    assert filtered.columns == df.columns and {r.doc_id for r in filtered.collect()} == kept[0]


def test_empty_table(empty):
    assert quality.measure(empty).count() == 0
    assert quality.filter_quality(empty).count() == 0
