"""The corpus pipeline on documents with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from test_language import SYLLABLES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark, folder):
    draw = random.Random(3)

    def prose(lang, n):
        return ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(2, 4))) for _ in range(n)]

    rows = []
    for i in range(200):
        lang = draw.choice(sorted(SYLLABLES))
        rows.append([i, " ".join(prose(lang, 300)), lang, draw.choice(["a", "b", None])])
    near = rows[10][1].split()
    near[50], near[200] = "kano", "shita"
    passage = " ".join(prose("xx", 25))
    rows += [
        [1000, rows[3][1], rows[3][2], "a"],
        [1001, " ".join(near), rows[10][2], "a"],
        [1002, " ".join(prose("xx", 100) + [passage] + prose("xx", 100)), "xx", "b"],
        [1003, " ".join(prose("yy", 100)) + " password=hunter2hunter2 end", "yy", "b"],
        [1004, "... 123 !!!", "zz", "a"],
        [1005, None, None, None],
        [1006, "", "xx", "a"],
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], ", ".join(
        f"{c} {k}" for c, k in zip(COLUMNS, ("long", "string", "string", "string", "long"))
    ))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert ids - set(left["language_id"]) == {1004, 1005, 1006}
    assert set(left["language_id"]) - set(left["simhash"]) == {1000, 1001}
    assert set(left["simhash"]) - set(left["decontaminate"]) == {1002}
    assert set(left["secrets"]) == set(left["decontaminate"])
    cleaned = left["secrets"][1003]
    assert cleaned.text.endswith(" [secret] end") and cleaned.n_chars == len(cleaned.text)
    assert all(left["secrets"][i].text == rows[i][1] for i in range(200))
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} == set(left["secrets"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, mixed))
