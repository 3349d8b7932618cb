from __future__ import annotations

import random

import pytest
from llm_rows import EDGE, make

from tidemark.llm import language

SYLLABLES = {"xx": ["ka", "no", "mi", "ru", "ta", "shi"], "yy": ["der", "und", "sch", "gen", "ung", "ein"], "zz": ["eau", "oir", "que", "ment", "tre", "les"]}


def corpus(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(draw.choice([8, 60, 2000]))]
        rows.append((1000 + i, " ".join(words), lang, None))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(300, 1)
    # A passage of one language quoted under another's label does not spoil the dictionaries.
    rows += [(5000 + i, rows[i][1] + " ", "yy", None) for i in range(20) if rows[i][2] == "xx"]
    df = make(spark, rows)
    dictionaries = language.fit_dictionaries(df.filter(~language.held_out()))
    assert sorted(dictionaries) == ["xx", "yy", "zz"] and len({len(c) for c in dictionaries.values()}) == 1
    truth = {d: l for d, _, l, _ in rows[:300]}
    judged = language.identify_language(df.filter(language.held_out()), dictionaries).collect()
    checked = [(truth[r.id], r.lang_pred) for r in judged if r.id in truth]
    assert len(checked) > 50 and sum(a == b for a, b in checked) / len(checked) > 0.97
    assert all(0 <= r.score <= 1 for r in judged)


def test_edge_rows(spark):
    dictionaries = language.fit_dictionaries(make(spark, corpus(100, 2)))
    df = make(spark, EDGE)
    got = language.identify_language(df, dictionaries).collect()
    assert len(got) == len(EDGE)
    by_id = {r.id: r for r in got if r.id is not None}
    for k in (1, 2, 3, 8):
        assert (by_id[k].lang_pred, by_id[k].score, by_id[k].rejected) == ("und", 0.0, True)
    assert by_id[5].lang_pred in dictionaries and len([r for r in got if r.id == 6]) == 2
    kept = language.keep_identified(df, dictionaries)
    assert kept.columns == df.columns
    accepted = sorted((r.id for r in got if not r.rejected), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == accepted


def test_nothing_learned_and_empty_table(spark, empty):
    assert language.fit_dictionaries(empty) == {}
    assert {r.lang_pred for r in language.identify_language(make(spark, EDGE), {}).collect()} == {"und"}
    assert language.identify_language(empty, {}).count() == 0


@pytest.mark.parametrize("words", [10, 5000])
def test_one_language_is_never_in_doubt(words):
    encoders = language.Encoders({"xx": ("kano miru " * 50).encode()})
    name, score, over, margin = encoders.judge("kano " * words)
    assert (name, score) == ("xx", 1.0) and over > 0 and margin > 0


def test_a_text_without_letters_has_no_language():
    encoders = language.Encoders({"xx": ("kano miru " * 50).encode(), "yy": ("derung schein " * 40).encode()})
    for text in ("½ ² ① 123 _", "", "...", "\u0301"):
        assert encoders.judge(text)[:2] == ("und", 0.0)
    assert encoders.judge("½ kano")[0] == "xx"


def test_a_scarce_language_costs_the_others_nothing(spark):
    rows = corpus(300, 4)
    rare = [(9000, "zwak qorv blyx " * 4 + "tumpf", "rare", None)]
    alone, joined = (language.fit_dictionaries(make(spark, r)) for r in (rows, rows + rare))
    assert sorted(joined) == ["rare", "xx", "yy", "zz"] and len(joined["rare"]) < 100
    assert {len(joined[n]) for n in ("xx", "yy", "zz")} == {len(alone[n]) for n in ("xx", "yy", "zz")}
    truth = corpus(200, 5)
    judged = {r.id: r.lang_pred for r in language.identify_language(make(spark, truth), joined).collect()}
    assert sum(judged[d] == l for d, _, l, _ in truth) / len(truth) > 0.97


def test_rows_that_share_one_id_are_sampled(spark):
    rows = [(7 if lang == "xx" else None if lang == "yy" else d, t, lang, s) for d, t, lang, s in corpus(300, 6)]
    found = language.fit_dictionaries(make(spark, rows), rows_per_language=20)
    assert sorted(found) == ["xx", "yy", "zz"] and min(map(len, found.values())) > 1000
